"""Command line: ``python -m tallystone COMMAND PATH...``; ``list-metrics`` names the measures."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import deployment, graph, sast, sast_rules
from .plans import analysis, reports
from .shipping import ship
from .sources import tree


#: Measures with a command of their own: what they are, and their columns of the analysis.
MEASURES = {
    "score": ("levels 1 to 3 and their composite", ("l1", "l2", "l3", "acds", "measured", "unmeasured")),
    "dfr": ("whether the dependency graph can be deployed or repaired", ("cycles", "rating")),
    "drd": ("cost of the cheapest repair of all cycles", ("cycles", "drd")),
    "icr": ("calls that meet an endpoint", ("icr",)),
    "ccs": ("configuration names that are defined", ("ccs",)),
    "urr": ("internal imports that resolve to nothing", ("urr",)),
    "hd": ("packages that the registry (--registry) lacks, per 1,000 lines", ("hd",)),
    "csd": ("smells per 1,000 lines", ("csd",)),
    "ccx": ("mean complexity of functions", ("ccx",)),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallystone", description="Measures of technical debt in source trees.")
    parser.add_argument("command", choices=["analyse", "checks", "scan", "graph", "id", "list-metrics", *MEASURES])
    parser.add_argument("paths", nargs="*", help="project folders")
    parser.add_argument("--registry", help="Parquet table of known packages (ecosystem, name, exists)")
    parser.add_argument("--format", default="table", choices=["table", "json", "csv", "md", "html"])
    parser.add_argument("--out", help="file to write to instead of standard output")
    args = parser.parse_args(argv)
    if args.command == "list-metrics":
        print("\n".join([f"{name}: {what}" for name, (what, _) in MEASURES.items()] + ["id: the highest of ten stages that the files pass"]))
        return 0
    if not args.paths:
        parser.error("name at least one project folder")
    spark = SparkSession.builder.appName("tallystone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    files = tree.read_tree(spark, path=",".join(args.paths))
    registry = spark.read.parquet(args.registry) if args.registry else None
    if args.command == "analyse":
        df = analysis.analyse(files, registry)
    elif args.command in MEASURES:
        df = analysis.analyse(files, registry).select("project_id", *MEASURES[args.command][1])
    elif args.command == "id":
        df = deployment.illusion_depth(tree.analysed(files))
    elif args.command == "checks":
        df = analysis.checks(files).orderBy("project_id", "name")
    elif args.command == "scan":
        rank = sast.severity_rank(F.col("severity"))
        df = sast.capped(sast.scan(tree.scanned(files), sast_rules.RULES)).orderBy(rank, "project_id", "path", "line_no")
    else:
        df = graph.edge_map(analysis.all_edges(tree.analysed(files))).orderBy("project_id", "src", "dst")
    rows = reports.rows_of(df)
    if args.format == "table":
        text = reports.to_markdown(rows, args.command)
    else:
        text = {"json": reports.to_json, "csv": reports.to_csv, "md": reports.to_markdown, "html": reports.to_html}[args.format](rows)
    if args.out:
        with open(args.out, "w") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Dependency graphs: edge map, strongly connected components, cycles, feasibility and repair cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Repair cost of an edge by its type.
EDGE_COST = {"ADDR": 1, "STATE": 2, "RUNTIME": 0}


def edge_map(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The surviving edge of each (project, src, dst): the last by ``seq``. Edges with an end that is no node are dropped."""
    if nodes is not None:
        for end in ("src", "dst"):
            edges = edges.join(nodes.select("project_id", F.col("id").alias(end)).distinct(), ["project_id", end], "left_semi")
    rest = [c for c in edges.columns if c not in ("project_id", "src", "dst")]
    return edges.groupBy("project_id", "src", "dst").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("project_id", "src", "dst", "e.*")


def components_of(src: list, dst: list) -> dict:
    """Node to the smallest node of its strongly connected component: forward order by finish, then backward sweeps."""
    out: dict = {}
    back: dict = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
        back.setdefault(b, []).append(a)
    finished, seen = [], set()
    for start in sorted(out):
        if start in seen:
            continue
        seen.add(start)
        work = [(start, iter(out[start]))]
        while work:
            node, rest = work[-1]
            new = next((x for x in rest if x not in seen), None)
            if new is None:
                finished.append(node)
                work.pop()
            else:
                seen.add(new)
                work.append((new, iter(out[new])))
    label: dict = {}
    for node in reversed(finished):
        if node not in label:
            members, work = [], [node]
            label[node] = node
            while work:
                x = work.pop()
                members.append(x)
                for y in back.get(x, ()):
                    if y not in label:
                        label[y] = node
                        work.append(y)
            low = min(members)
            for x in members:
                label[x] = low
    return label


def by_project(frames):
    """Slices of frames that are sorted by project: whole projects, many at a time; only one that spans frames is held."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        project = pdf["project_id"].to_numpy()
        if held and held[-1]["project_id"].iloc[-1] != project[0]:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        cut = int(np.flatnonzero(project == project[-1])[0])
        if cut:
            yield pd.concat([*held, pdf.iloc[:cut]])
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held)


def labelled(pdf: pd.DataFrame):
    """``(from, to, labels)`` for the rows of each project of a sorted frame."""
    project, src, dst = pdf["project_id"].to_numpy(), pdf["src"].tolist(), pdf["dst"].tolist()
    cuts = [0, *(np.flatnonzero(project[1:] != project[:-1]) + 1).tolist(), len(project)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield a, b, components_of(src[a:b], dst[a:b])


def _together(edges: DataFrame) -> DataFrame:
    return edges.repartition("project_id").sortWithinPartitions("project_id")


def scc(edges: DataFrame) -> DataFrame:
    """``(project_id, node, scc)``. Projects are worked one after another in a task; a project's graph is at most its own files' size."""
    kind, key = dict(edges.dtypes)["src"], dict(edges.dtypes)["project_id"]

    def kernel(frames):
        for pdf in by_project(frames):
            rows = [(pdf["project_id"].iloc[a], n, c) for a, _, label in labelled(pdf) for n, c in label.items()]
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(("project_id", "node", "scc"), zip(*rows, strict=True), strict=True)})

    return _together(edges.select("project_id", "src", "dst")).mapInPandas(kernel, f"project_id {key}, node {kind}, scc {kind}")


def inner_edges(edges: DataFrame) -> DataFrame:
    """Edges within one component (self-loops included), with the component as ``cycle``, in one pass over the edges."""
    kept = edges.select("project_id", "src", "dst", "edge_type", "atomic")

    def kernel(frames):
        for pdf in by_project(frames):
            src, dst = pdf["src"].tolist(), pdf["dst"].tolist()
            ends = [(label[src[i]], label[dst[i]]) for a, b, label in labelled(pdf) for i in range(a, b)]
            inside = [i for i, (x, y) in enumerate(ends) if x == y]
            columns = {c: [values[i] for i in inside] for c in pdf.columns for values in [pdf[c].tolist()]}
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()} | {"cycle": pd.Series([ends[i][0] for i in inside], dtype=object)})

    types = dict(kept.dtypes)
    return _together(kept).mapInPandas(kernel, ", ".join(f"{c} {t}" for c, t in types.items()) + f", cycle {types['src']}")


def cycle_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Surviving edges within one component (self-loops included), with the component as ``cycle``."""
    a = labels.select("project_id", F.col("node").alias("src"), F.col("scc").alias("cycle"))
    b = labels.select("project_id", F.col("node").alias("dst"), F.col("scc").alias("cycle_b"))
    return edges.join(a, ["project_id", "src"]).join(b, ["project_id", "dst"]).where("cycle = cycle_b").drop("cycle_b")


def cycles(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per cycle (a component with an inner edge): nodes, edges, whether stateful, whether irreparable, cost of its cheapest edge.

    Irreparable: STATE edges both ways between two nodes, one of them atomic (an atomic STATE self-loop is its own reverse).
    """
    inner = cycle_edges(edges, labels) if labels is not None else inner_edges(edges)
    rev = inner.where("edge_type = 'STATE'").select("project_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("atomic").alias("back_atomic"))
    both = inner.join(rev, ["project_id", "src", "dst"], "left")
    stuck = (F.col("edge_type") == "STATE") & F.col("back_atomic").isNotNull() & (F.col("atomic") | F.col("back_atomic"))
    cost = F.create_map(*[F.lit(x) for kv in EDGE_COST.items() for x in kv])[F.col("edge_type")]
    # a cheapest edge: runtime edges rank above nothing and cost nothing
    return both.groupBy("project_id", "cycle").agg(
        F.count_distinct("src").alias("n_nodes"), F.count("*").alias("n_edges"), F.bool_or(F.col("edge_type") == "STATE").alias("has_state"), F.bool_or(F.coalesce(stuck, F.lit(False))).alias("irreparable"), F.min(cost).cast("long").alias("min_cost")
    )


def feasibility(projects: DataFrame, found: DataFrame) -> DataFrame:
    """Per project: number of cycles, rating, repair pattern and repair distance (-1: irreparable).

    Components don't share edges, so the cheapest set of edges that covers all cycles is the cheapest edge of each.
    """
    per = found.groupBy("project_id").agg(F.count("*").alias("cycles"), F.count_if("has_state").alias("stateful"), F.count_if("irreparable").alias("stuck"), F.sum("min_cost").alias("cost"))
    n = F.coalesce("cycles", F.lit(0))
    none, stuck, stateless = n == 0, F.coalesce("stuck", F.lit(0)) > 0, F.coalesce("stateful", F.lit(0)) == 0
    rating = F.when(none, "DEPLOYABLE").when(stuck, "IRREPARABLE").otherwise("REPAIRABLE")
    pattern = F.when(none | stuck, F.lit("NONE")).when(stateless, "DARC").otherwise("SDB")
    distance = F.when(none, 0).when(stuck, -1).otherwise(F.col("cost"))
    return projects.select("project_id").distinct().join(per, "project_id", "left").select("project_id", n.cast("long").alias("cycles"), rating.alias("rating"), pattern.alias("pattern"), distance.cast("long").alias("drd"))


def edge_stats(edges: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("edge_type") == k).alias(f"n_{k.lower()}") for k in EDGE_COST]
    return edges.groupBy("project_id").agg(F.count("*").alias("n_edges"), *kinds, F.count_if(F.col("atomic")).alias("n_atomic"), F.count_if(F.col("src") == F.col("dst")).alias("n_self"))

"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Only DataFrame functions are used. Two first-order models over 65 character classes are
estimated from labelled strings: strings drawn at random (digests of a counter, written
in base 64, base 32 and base 16) and identifiers that occur as words. A candidate's score
is its log-likelihood ratio for each pair of characters; candidates above the threshold are spans of kind ``markov``.
"""

from __future__ import annotations

import builtins
import math
import os
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The contract's kinds, their patterns (Java), the group whose length counts and its least length.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A candidate of the Markov models: every run of 16 or more token characters, also after a sign of assignment.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-"
CLASSES = len(ALPHABET) + 1


def char_class(c: Column) -> Column:
    """1 to 65 by place in the alphabet; ``_`` and ``=`` share the last class."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at == 0, CLASSES).otherwise(at)


def labelled_strings(docs: DataFrame, text_col: str, n_random: int, n_ordinary: int, per_document: int = 200) -> DataFrame:
    """``(s, label)``: 1 for drawn strings, 0 for identifiers, paths, bare numbers and rules.

    The bound is ``2 n_random`` and ``n_ordinary`` strings, ``per_document`` of a document. Identifiers and paths are runs of token
    characters of 6 to 15 with at most two digits (so no candidate trains the model that judges it), from
    documents whose hashed text is divisible by a number that leaves about ``n_ordinary / 20`` of them, and the names in a few modules of Python,
    also joined as paths. Bare numbers are drawn; rules are one sign repeated.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("markov:"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    drawn = spark.range(n_random).select(F.when(F.col("id") % 4 < 2, b64).when(F.col("id") % 4 == 2, F.upper(F.translate(digest, "0189", "ghij"))).otherwise(digest).alias("s"), F.lit(1).alias("label"))
    few = F.pmod(F.xxhash64(text_col), F.lit(max(1, docs.count() // max(1, n_ordinary // 20)))) == 0
    words = docs.where((F.length(text_col) > 0) & few).select(F.explode(F.slice(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z0-9+/_-]{6,}"), 0)), 1, per_document)).alias("s"))
    words = words.where(~F.col("s").rlike("[0-9].*[0-9].*[0-9]") & (F.length("s") < 16)).distinct().orderBy(F.xxhash64("s"), "s").limit(n_ordinary).select("s", F.lit(0).alias("label"))
    # names of the language's own library stand in where the texts hold few
    names = sorted({n.strip("_") for n in (*dir(builtins), *sys.stdlib_module_names, *dir(str), *dir(os), *dir(math)) if len(n) > 5})
    paths = ["/" + "/".join(names[i : i + 4]) for i in range(0, len(names), 4)]
    rules = [c * 80 for c in "+-/_="] + [c * 40 for c in ALPHABET[:62]]
    given = spark.range(1).select(F.explode(F.split(F.lit(",".join([*names, *paths, *rules])), ",")).alias("s"), F.lit(0).alias("label"))
    numbers = spark.range(n_random).select(F.regexp_replace(digest, "[a-f]", "").alias("s"), F.lit(0).alias("label"))
    return drawn.unionByName(words).unionByName(given).unionByName(numbers)


def train_ratios(strings: DataFrame, backoff: float = 5.0) -> list[float]:
    """The log ratio of the two models for each pair of classes, row by row: 65 x 65 numbers.

    A pair's probability backs off to that of its second class. Pair counts are one
    aggregate; the driver gets 2 x 65 x 65 counts at most.
    """
    n = F.length("s")
    pairs = strings.where(n > 1).select("label", F.explode(F.expr("transform(sequence(1, length(s) - 1), i -> substring(s, i, 2))")).alias("p"))
    cell = ((char_class(F.substring("p", 1, 1)) - 1) * CLASSES + char_class(F.substring("p", 2, 1)) - 1).cast("int")
    counts = [[0] * (CLASSES * CLASSES) for _ in range(2)]
    for r in pairs.groupBy("label", cell.alias("cell")).agg(F.count("*").alias("n")).collect():
        counts[r["label"]][r["cell"]] += r["n"]
    logs = []
    for c in counts:
        single = [(sum(c[b::CLASSES]) + 0.5) / (sum(c) + 0.5 * CLASSES) for b in range(CLASSES)]
        rows = [sum(c[a * CLASSES : (a + 1) * CLASSES]) for a in range(CLASSES)]
        logs.append([math.log((c[a * CLASSES + b] + backoff * single[b]) / (rows[a] + backoff)) for a in range(CLASSES) for b in range(CLASSES)])
    return [x - y for x, y in zip(logs[1], logs[0], strict=True)]


def match_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of ``(start, end, kind, value)`` of the leftmost non-overlapping matches, in code points.

    The text split at the pattern and the matches themselves alternate, so running sums of
    their lengths give the places.
    """
    between = F.split(text, pattern, -1)
    whole, own = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), group)
    empty = F.array().cast("array<struct<start:int,end:int,value:string,own:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("value"), F.length(x["own"]).alias("own")))).alias("spans"))

    found = F.transform(whole, lambda w, i: F.struct(w.alias("whole"), F.get(own, i).alias("own"), F.get(between, i).alias("gap")))
    placed = F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]
    named = F.transform(F.filter(placed, lambda s: s["own"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
    return F.when(text.rlike(pattern), named).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))


def ratio(value: Column, table: Column) -> Column:
    """The mean log-likelihood ratio over a string's adjacent pairs.

    The array of classes is made once per string, outside the sum."""
    classes = F.transform(F.split(value, ""), char_class)
    total = F.aggregate(
        classes,
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] == 0, acc["sum"]).otherwise(acc["sum"] + F.get(table, (acc["last"] - 1) * CLASSES + c - 1)).alias("sum")),
    )["sum"]
    return total / F.greatest(F.lit(1), F.length(value) - 1)


def find_secrets(docs: DataFrame, text_col: str = "text", threshold: float = 0.6, n_random: int = 4000, n_ordinary: int = 20_000) -> DataFrame:
    """``docs`` with ``spans``: array of ``(start, end, kind, value)`` by start, then kind in the order assign, access, hex, markov.

    Places are in code points, end exclusive. A Markov span never overlaps a pattern's. A
    null text has no spans; all other columns and repeated rows stay. No shuffle but for
    the bounded training sample; the model is a literal of 4,225 numbers. An input column
    named ``spans`` is replaced.
    """
    fixed, other = fresh(docs.columns, "fixed", "other")
    model = train_ratios(labelled_strings(docs, text_col, n_random, n_ordinary))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(fixed, F.concat(*[match_spans(text, *k) for k in KINDS]))
    out = out.withColumn(other, match_spans(text, "markov", CANDIDATE, 0, 16))
    clear = F.filter(F.col(other), lambda s: ~F.exists(F.col(fixed), lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    added = F.filter(clear, lambda s: ratio(s["value"], table) > threshold)
    place = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    both = F.concat(F.col(fixed), F.when(F.size(other) > 0, added).otherwise(F.filter(F.col(other), lambda s: F.lit(False))))
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("a"), place(s["kind"]).alias("b"), s["end"].alias("c"), s.alias("s"))))
    return out.withColumn("spans", F.transform(keyed, lambda x: x["s"])).drop(fixed, other)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<|secret|>", **options) -> DataFrame:
    """``docs`` with each secret of the texts replaced by ``mark``; columns stay as they are.

    Overlapping spans become one mark over their union. Null texts stay null, repeated rows each stay, columns of any name pass through.
    """
    columns = docs.columns
    if "spans" in columns:  # the operator's own column would replace it
        (kept,) = fresh(columns, "own_spans")
        return redact(docs.withColumnRenamed("spans", kept), text_col, mark, **options).withColumnRenamed(kept, "spans").select(*columns)
    found = find_secrets(docs, text_col, **options)
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out")))

    cut = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    new = F.when(F.size("spans") > 0, cut).otherwise(text)
    return found.withColumn(text_col, new).select(*columns)

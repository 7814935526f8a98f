"""Quality rules with cross-document line frequency.

One Python pass counts what each text says about itself and hashes its normalised lines;
everything across documents is DataFrame aggregation. A line is frequent on a host if more
than ``max_docs`` distinct texts of that host hold it. Frequent lines count as removed from
every document but the one of smallest id that holds them, so a group of copies keeps one
whole member. A document whose remaining words are too few is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, rows_of, spread_join, staged

#: Characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 5


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair, exactly."""
    return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(numbers) == len(words):
        return 0
    two = paired(ids[:-1], ids[1:])
    four = paired(two[:-2], two[2:])
    five = paired(four[:n], ids[4:])
    often = np.bincount(five)[five] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_profile(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, text hash, line hashes, words of each line)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, WHITE))
    seen: set[bytes] = set()
    dup = 0
    lines: dict[int, int] = {}
    for line in raw.split(b"\n"):
        own = line.lower().split()
        if own:
            dup += line in seen
            seen.add(line)
            h = signed(xxhash.xxh3_64_intdigest(b" ".join(own)))
            lines[h] = lines.get(h, 0) + len(own)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), signed(xxhash.xxh3_64_intdigest(raw)), list(lines), list(lines.values())


PROFILE = "key long, id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, copy long, lines array<long>, line_words array<long>"


def profiles(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def run(batches):
        names = [x.split()[0] for x in PROFILE.split(", ")]
        for keys, ids, hosts, texts in rows_of(batches, ["key", "id", "host", "t"]):
            cols = list(zip(*map(text_profile, texts), strict=True))
            arrays = [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), *[pa.array(c, pa.int64()) for c in cols[:6]], *[pa.array(c, pa.list_(pa.int64())) for c in cols[6:]]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    key = F.xxhash64(id_col, host_col, text_col)
    return docs.select(key.alias("key"), F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("t")).mapInArrow(run, PROFILE)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, min_words: int = 10, min_left: float = 0.2, max_repeat: float = 0.2, with_key: bool = False) -> DataFrame:
    """Per row of ``docs``: id, the base counts, ``base_failed``, ``n_words_left`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` of them in
    repeated 5-word windows. ``kept``: not failed, and after frequent lines are removed at
    least ``min_words`` words and ``min_left`` of all words are left. Lines are compared with
    A-Z lower-cased and white space collapsed; texts alike to the byte count as one document.
    A null text counts as empty (and fails); a null host is a host of its own; rows with a
    null id never hold a line first; repeated rows get equal results. Other columns are not
    read.

    Scale: the text is read once. Counting by (host, line) combines before the shuffle, so a
    line or host of a third of all rows is no hot spot; only frequent lines are joined back to the documents' lines, the most frequent ones
    salted.
    """
    base = staged(profiles(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "profiles")
    host = F.xxhash64(F.col("host").isNull(), F.col("host"))
    held = base.where(F.size("lines") > 0).select("row", "id", host.alias("hk"), "copy", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "id", "hk", "copy", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w"))
    frequent = held.groupBy("hk", "line").agg(F.countDistinct("copy").alias("n"), F.min("id").alias("first"), F.count("*").alias("times")).where(F.col("n") > max_docs).select("hk", "line", "first", "times")
    later = spread_join(held, staged(frequent, "frequent"), ["hk", "line"], "times", F.col("row")).where(~F.col("id").eqNullSafe(F.col("first")))
    gone = later.groupBy("row").agg(F.sum("w").alias("w"), F.collect_set("line").alias("gone"))
    joined = base.drop("lines", "line_words", "copy", "host").join(gone, "row", "left")
    left = (F.col("n_words") - F.coalesce(F.col("w"), F.lit(0))).alias("n_words_left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(round(100 * max_repeat)) * F.col("n_words"))
    enough = (F.col("n_words_left") >= min_words) & (F.col("n_words_left") >= min_left * F.col("n_words"))
    out = joined.select(*["key", "gone"] * with_key, F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", left, failed.alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & enough)


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose normalised form hashes into ``gone``."""
    own = lambda line: signed(xxhash.xxh3_64_intdigest(b" ".join(line.encode().lower().split())))
    return "\n".join(line for line in text.split("\n") if not (line.strip(WHITE) and own(line) in gone))


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``docs`` without the rows that ``quality`` rejects, their texts without frequent lines; other columns stay as they are.

    Repeated rows pass each for itself. A line that recurs in one text leaves it wherever it stands; blank lines stay. An empty
    table stays empty; columns of any name pass through. The texts are shuffled once, by a hash of the row.
    """
    columns = docs.columns
    key, gone_, own = fresh(columns, "key", "gone", "own")
    found = quality(docs, id_col, text_col, host_col, with_key=True, **limits).where("kept")
    kept = found.select(F.col("key").alias(key), F.col("gone").alias(gone_), F.col(id_col).alias(own)).dropDuplicates([key, own])

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                gone, texts = part.column(len(columns)).to_pylist(), part.column(columns.index(text_col)).to_pylist()
                new = pa.array([without_lines(t, set(g)) if g and t else t for t, g in zip(texts, gone, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if c == text_col else part.column(i) for i, c in enumerate(columns)], columns)

    keyed = docs.withColumn(key, F.xxhash64(id_col, host_col, text_col))
    joined = keyed.join(kept, (keyed[key] == kept[key]) & keyed[id_col].eqNullSafe(kept[own])).select(*[keyed[c] for c in columns], gone_)
    return joined.mapInArrow(cut, docs.schema)

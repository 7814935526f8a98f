"""Substring deduplication over sliding spans of consecutive sentences.

From each sentence of a text runs a span, and to each runs one: the shortest run of at least ``min_sentences``
sentences with ``min_words`` words, or that sentence alone if it has ``long_words`` words. So every sentence of a
repeated passage lies in a span inside it. A text too short for any span is one itself.
Spans are hashed and joined over the whole corpus. A span that occurs more than once is
repeated; every occurrence but the first (by document id, then place) marks its sentences,
and marked sentences are removed.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, spread_join, staged

SENTENCE_END = re.compile(r"[.!?]+[\s]+|\n+")


def sentences(text: str) -> list[str]:
    """The text cut after each sentence end or line end; the parts join to the text."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def spans(text: str, min_sentences: int, min_words: int, long_words: int) -> list[tuple[int, int, int]]:
    """(hash, first sentence, number of sentences) of each span; compared with A-Z lower-cased and white space collapsed."""
    words = [s.encode().lower().split() for s in sentences(text)]
    n = len(words)
    flat = [b" ".join(w) + b" " if w else b"" for w in words]
    whole = b"".join(flat)
    place, at = [0], 0
    for f in flat:
        at += len(f)
        place.append(at)
    size = [len(w) for w in words]
    out = []
    end = have = 0  # the run is [i, end) and has so many words
    full = 0  # sentences of the run that are not blank
    for i in range(n):
        while end < n and (have < min_words or full < min_sentences):
            have += size[end]
            full += size[end] > 0
            end += 1
        if size[i]:
            if size[i] >= long_words:
                out.append((xxhash.xxh3_64_intdigest(whole[place[i] : place[i + 1]]), i, 1))
            if have >= min_words and full >= min_sentences:
                out.append((xxhash.xxh3_64_intdigest(whole[place[i] : place[end]]), i, end - i))
        have -= size[i]
        full -= size[i] > 0
        if end == i:
            end = i + 1
    known = {(i, k) for _, i, k in out}
    begin = have = full = 0  # the run is [begin, j]
    for j in range(n):
        have += size[j]
        full += size[j] > 0
        while have - size[begin] >= min_words and full - (size[begin] > 0) >= min_sentences:
            have -= size[begin]
            full -= size[begin] > 0
            begin += 1
        while begin < j and not size[begin]:
            begin += 1
        if size[j] and have >= min_words and full >= min_sentences and (begin, j + 1 - begin) not in known:
            out.append((xxhash.xxh3_64_intdigest(whole[place[begin] : place[j + 1]]), begin, j + 1 - begin))
    if not out and whole:
        out.append((xxhash.xxh3_64_intdigest(whole), 0, n))
    return [(h - (1 << 64) if h >> 63 else h, i, k) for h, i, k in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 20, long_words: int = 25) -> DataFrame:
    """Per row of ``docs``: id, ``text`` without repeated spans, ``n_sentences``, ``n_removed`` and ``removed_chars``.

    Rows alike in id and text are one document: they are searched once and get one result.
    A null text stays null with counts of 0; an empty one stays empty. Null ids come before
    all others in the order of occurrences. A text keeps its characters except for the
    removed sentences (and white space then left at its end). Other columns are not read.

    Scale: spans are three numbers each. Their aggregation combines before the shuffle, so a
    passage in a third of all documents is no hot spot; only the hashes found repeated are
    joined back, the frequent ones salted. Texts are shuffled once.
    """
    key = F.xxhash64(id_col, text_col)

    def find(batches):
        for keys, ids, texts in rows_of(batches, ["k", "id", "t"]):
            rows = [(k, d, *s) for k, d, t in zip(keys, ids, texts, strict=True) if t for s in spans(t, min_sentences, min_words, long_words)]
            k, d, h, i, n = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(i, pa.int32()), pa.array(n, pa.int32())], ["k", "id", "h", "i", "n"])

    texts = docs.select(key.alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = staged(texts.mapInArrow(find, "k long, id long, h long, i int, n int"), "spans")
    at = F.struct(F.col("id"), F.col("k"), F.col("i"))
    repeated = found.groupBy("h").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("times")).where(F.col("first") != F.col("last")).select("h", "first", "times")
    later = spread_join(found, staged(repeated, "repeated"), ["h"], "times", F.struct("k", "i")).where(at != F.col("first"))
    marks = later.groupBy("k").agg(F.collect_set(F.struct("i", "n")).alias("marks")).withColumnRenamed("k", "mk")
    both = texts.join(marks, texts["k"] == marks["mk"], "left").select("id", "t", F.col("marks.i").alias("i"), F.col("marks.n").alias("n"))

    def cut(batches):
        for ids, whole, starts, counts in rows_of(batches, ["id", "t", "i", "n"]):
            out: list[tuple] = []
            for t, own, n in zip(whole, starts, counts, strict=True):
                parts = sentences(t) if t else []
                gone = {x for i, k in zip(own or (), n or (), strict=True) for x in range(i, i + k)}
                if gone:
                    kept = "".join(p for x, p in enumerate(parts) if x not in gone).rstrip()
                    out.append((kept, len(parts), len(gone), sum(len(parts[x]) for x in gone)))
                else:
                    out.append((t, len(parts), 0, 0))
            a, b, c, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.string()), *[pa.array(x, pa.int64()) for x in (b, c, d)]], [id_col, "text", "n_sentences", "n_removed", "removed_chars"])

    return both.mapInArrow(cut, f"`{id_col}` long, text string, n_sentences long, n_removed long, removed_chars long")

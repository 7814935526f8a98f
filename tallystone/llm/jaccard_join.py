"""Jaccard join over word shingles with an R-tree of count vectors.

A document is the set of its distinct shingles. Shingles are hashed into groups; the
numbers of shingles in each group are a point, and the overlap of two sets is at most the
sum of the coordinate minima of their points. An R-tree over points keeps, per node, the
coordinate maxima and the range of sizes, so one sum bounds the overlap with everything
below. Pairs that survive the bound are verified on the sets themselves.

One tree over a corpus would be one task's work, so documents first meet in buckets, by
their rarest shingles: two sets of similarity t or more share one of the first
``n - ceil(t n) + 1`` shingles in any common order. That loses no pair. Each bucket has its own tree.
Documents with equal sets are one node throughout. A first round visits the buckets of each set's
four smallest shingles and links copies; the exact round then visits only buckets that
still hold two components, and only pairs across components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, rows_of, spread_join, staged
from .components import components

#: Coordinates of a point, shingles of a set that name its buckets in the first round, points of a tree leaf, most documents of one bucket task and of one block, buckets that a node carries, shingles of one sort.
GROUPS = 128
FIRST = 4
LEAF = 16
CHUNK = 256
BLOCK = 4096
SEEN = 32
SORT = 1_000_000
#: Cells of the order's counts: a unit of the root of the text's bytes, least and most as powers of two, and cells of one row.
CELLS_A_ROOT, LEAST_CELLS, MOST_CELLS, PART = 32, 16, 24, 4096

MULT = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct 64-bit shingle hashes of texts, sorted; word hashes are remembered."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - self.width + 1)
        out = np.full(n, len(words) if len(words) < self.width else self.width, dtype=np.uint64)
        for i in range(min(self.width, len(words))):
            out = (out ^ (out >> np.uint64(29))) * MULT + h[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * MULT
        return np.unique(out ^ (out >> np.uint64(31)))


def point(shingles: np.ndarray) -> np.ndarray:
    """Numbers of shingles in each group.

    There are ``GROUPS`` groups for up to 8 times as many shingles, and 8 times more groups for each 8 times
    more shingles, as the bound prunes only where groups are small. Finer groups fold into coarser.
    """
    groups = GROUPS
    while 8 * groups < len(shingles):
        groups *= 8
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.uint16)


def folded(p: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return p.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def fine_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The bound on the overlap in the finest groups that both points have."""
    n = min(len(a), len(b))
    return int(np.minimum(folded(a, n), folded(b, n)).sum())


class CountTree:
    """An R-tree, packed level by level, over points of sets."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, t: int):
        self.t = t
        order = np.lexsort((points[:, 0], sizes)) if len(points) else np.empty(0, dtype=np.int64)
        self.order, self.points, self.sizes = order, points[order].astype(np.int32), sizes[order].astype(np.int64)
        self.levels = []  # from the leaves up: coordinate maxima, least and largest size
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > LEAF or not self.levels:
            cuts = np.arange(0, len(top), LEAF)
            if not len(cuts):
                break
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def may_link(self, p: np.ndarray, n: int, top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether overlap and sizes allow a link: t (n + m) <= (100 + t) overlap for the least size m below."""
        fits = (100 * high >= self.t * n) & (100 * n >= self.t * low)
        bound = np.minimum(np.minimum(top, p).sum(axis=1), np.minimum(high, n))
        return fits & ((100 + self.t) * bound >= self.t * (n + np.maximum(low, -(-self.t * n // 100))))

    def search(self, p: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the points whose sets may have the similarity with the given one."""
        p = p.astype(np.int32)
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.empty(0, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            at = at[self.may_link(p, n, top[at], low[at], high[at])]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        return self.order[at[self.may_link(p, n, self.points[at], self.sizes[at], self.sizes[at])]]


def linked(a: np.ndarray, b: np.ndarray, t: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= t * (len(a) + len(b) - both)


def link_bucket(ids: list[int], sets: list[np.ndarray], t: int) -> list[tuple[int, int]]:
    """A spanning forest of the verified links among some documents; pairs already connected are not verified again."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    points, sizes = np.array([folded(point(s)) for s in sets]), np.array([len(s) for s in sets])
    tree, out = CountTree(points, sizes, t), []
    for i in range(len(ids)):
        for j in tree.search(points[i], len(sets[i])).tolist():
            if i != j and (a := find(i)) != (b := find(j)) and linked(sets[i], sets[j], t):
                root[b] = a
                out.append((ids[i], ids[j]))
    return out


def grouped(batches, keys: list[str], columns: list[str]):
    """Rows of each run of equal keys, from batches that are sorted by them; one run is held at a time."""
    last, rows = None, []
    for cols in rows_of(batches, keys + columns, 256):
        for row in zip(*cols, strict=True):
            if row[: len(keys)] != last:
                if rows:
                    yield last, rows
                last, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield last, rows


def rarity(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """By cell of the shingle hashes, the bit length of the number of documents' shingles in it, over all documents.

    The order of shingles is by this, then by hash: rare ones first. Cells follow the square root of the text's bytes, between
    2^16 and 2^24, one byte each, so the result fits driver and broadcast. It decides the size of buckets, never a result.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MOST_CELLS, max(LEAST_CELLS, math.ceil(math.log2(CELLS_A_ROOT * math.sqrt(size + 1)))))
    shift = np.uint64(64 - bits)

    def count(batches):
        shingle, counts = Shingler(width), np.zeros(1 << bits, dtype=np.uint32)
        for (texts,) in rows_of(batches, [text_col]):
            for t in texts:
                np.add.at(counts, (shingle(t) >> shift).astype(np.int64), 1)
        parts = counts.reshape(-1, PART)
        for at in range(0, len(parts), 64):
            some = [r for r in range(at, min(at + 64, len(parts))) if parts[r].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[r].tobytes() for r in some], pa.binary())], ["r", "pack"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for rs, packs in rows_of(batches, ["r", "pack"], 64):
            for r, p in zip(rs, packs, strict=True):
                if r not in sums:
                    sums[r] = np.zeros(PART, dtype=np.int64)
                sums[r] += np.frombuffer(p, dtype=np.uint32)
        levels = [np.frexp(c.astype(np.float64))[1].astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["r", "pack"])

    counted = docs.select(text_col).mapInArrow(count, "r int, pack binary").repartition("r").mapInArrow(add, "r int, pack binary")
    out = np.zeros(1 << bits, dtype=np.uint8)
    for r, p in counted.collect():
        out[r * PART : (r + 1) * PART] = np.frombuffer(p, dtype=np.uint8)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, t: int, width: int) -> DataFrame:
    """Per row: key of the row, id, set size, digest of the set, its smallest hashes, its prefix in the common order, and its point."""
    levels = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col, width))

    def run(batches):
        shingle, level = Shingler(width), levels.value
        shift = np.uint64(65 - len(level).bit_length())
        for keys, ids, texts in rows_of(batches, ["k", "id", "t"], 256):
            sets = [shingle(x) for x in texts]
            prefixes, firsts = [], []
            for s in sets:
                firsts.append(s[:FIRST].tobytes())
                p = len(s) - -(-t * len(s) // 100) + 1 if len(s) else 0
                rare = np.argsort(level[(s >> shift).astype(np.int64)], kind="stable")[:p]
                prefixes.append(s[rare].tobytes())
            fp = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(firsts, pa.binary()), pa.array(prefixes, pa.binary()), pa.array([point(s).tobytes() for s in sets], pa.binary())],
                ["k", "id", "n", "fp", "first", "prefix", "point"],
            )

    rows = docs.select(F.xxhash64(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return staged(rows.mapInArrow(run, "k long, id long, n long, fp binary, first binary, prefix binary, point binary"), "signatures")


def first_keys(reps: DataFrame) -> DataFrame:
    """``(key, node)`` of the smallest shingles of each set."""
    part = lambda i: F.conv(F.hex(F.substring("first", 8 * i + 1, 8)), 16, -10).cast("long")
    parts = F.array(*[F.when(F.length("first") >= 8 * (i + 1), part(i)) for i in range(FIRST)])
    return reps.select("node", F.explode(F.array_compact(parts)).alias("key"))


def likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most rows whose ``node`` isn't wanted, so that their texts are not shuffled.

    A bitmap of 2^25 bits in 1,024 rows is broadcast: 4 MB whatever the input. More nodes than it can tell apart
    let more rows through and change nothing else.
    """
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << 25))
    bits = wanted.select(F.shiftright(spot, 15).alias("b"), spot.bitwiseAND(32767).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(F.col("p"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = texts.withColumns({"b": F.shiftright(spot, 15), "p": spot.bitwiseAND(32767)}).join(F.broadcast(bits), "b")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1L, cast(p & 7 as int))")) != 0).select("node", "t")


def with_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, width: int, carry: str, fields: str) -> DataFrame:
    """Shingle sets of the documents that ``wanted`` (column ``node``) names, with its array ``carry`` of structs exploded next to them."""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]
    texts = docs.select(F.xxhash64(id_col, text_col).alias("node"), F.col(text_col).alias("t"))
    rows = likely(texts, wanted).join(wanted, "node").dropDuplicates(["node"])
    rows = rows.select("node", "t", *[F.col(carry)[c].alias(c) for c in names])

    def run(batches):
        shingle = Shingler(width)
        for nodes, texts, *lists in rows_of(batches, ["node", "t", *names], 64):
            out: list[list] = [[] for _ in range(len(names) + 2)]
            for node, text, *own in zip(nodes, texts, *lists, strict=True):
                data = shingle(text).tobytes()
                for values in zip(*own, strict=True):
                    out[0].append(node)
                    out[1].append(data)
                    for o, v in zip(out[2:], values, strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), *[pa.array(o, x) for o, x in zip(out[2:], types, strict=True)]], ["node", "shingles", *names])

    return rows.mapInArrow(run, f"node long, shingles binary, {fields}")


LINK = "a long, b long"


def link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def first_round(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, t: int, width: int) -> DataFrame:
    """Verified links within the buckets of each set's first shingles.

    Buckets above ``CHUNK`` documents are dealt over several tasks, each of which also gets
    the bucket's smallest node, so that their trees connect. Work and data are linear in
    the bucket; links that this misses are left to the exact round.
    """
    member = first_keys(reps)
    buckets = member.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("low")).where("m > 1").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    placed = spread_join(member, staged(buckets, "buckets"), ["key"], "m", F.col("node"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    spots = F.when(F.col("node") == F.col("low"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    visits = placed.select("node", "key", F.explode(spots).alias("chunk")).groupBy("node").agg(F.collect_list(F.struct("key", "chunk")).alias("visits"))
    rows = with_sets(docs, id_col, text_col, visits, width, "visits", "key long, chunk int")

    def run(batches):
        for _, members in grouped(batches, ["key", "chunk"], ["node", "shingles"]):
            yield link_batch(link_bucket([m[0] for m in members], [np.frombuffer(m[1], dtype=np.uint64) for m in members], t))

    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(run, LINK)


def open_buckets(nodes: DataFrame, total: int) -> DataFrame:
    """``(key, node, label)`` of the buckets of all prefix shingles that two components share; buckets of the same nodes are one.

    Tasks pack their (shingle, node, label) triples by hash range into arrays, of which one row each
    travels; a range is sorted as an array. Ranges follow the number of shingles, so each
    sort has about ``SORT`` of them.
    """
    ranges = max(1, -(-total // SORT))

    def pack(batches):
        held: list[np.ndarray] = []

        def settle():
            rows = np.concatenate(held)
            held.clear()
            where = (rows[:, 0] % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            rows, where = rows[order], where[order]
            cuts = np.searchsorted(where, np.arange(ranges + 1))
            at = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([rows[cuts[r] : cuts[r + 1]].tobytes() for r in at], pa.binary())], ["r", "pack"])

        size = 0
        for ids, labels, prefixes in rows_of(batches, ["node", "label", "prefix"]):
            for node, label, p in zip(ids, labels, prefixes, strict=True):
                keys = np.frombuffer(p, dtype=np.uint64)
                own = np.empty((len(keys), 3), dtype=np.uint64)
                own[:, 0] = keys
                own[:, 1:] = np.array([node, label], dtype=np.int64).view(np.uint64)
                held.append(own)
                size += len(keys)
            if size > 500_000:
                yield settle()
                size = 0
        if held:
            yield settle()

    def find(batches):
        for _, packs in grouped(batches, ["r"], ["pack"]):
            rows = np.concatenate([np.frombuffer(p[0], dtype=np.uint64).reshape(-1, 3) for p in packs])
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            low, high = np.minimum.reduceat(rows[:, 2], starts), np.maximum.reduceat(rows[:, 2], starts)
            lengths = np.diff(np.append(starts, len(rows)))
            # the sum of its nodes' hashes names a bucket, so shingles of the same nodes are one
            h = (rows[:, 1] ^ (rows[:, 1] >> np.uint64(31))) * MULT
            name = np.add.reduceat((h ^ (h >> np.uint64(29))) * MULT, starts)
            once = np.zeros(len(starts), dtype=bool)
            once[np.unique(name, return_index=True)[1]] = True
            rows[:, 0] = np.repeat(name, lengths)
            rows = rows[np.repeat((low != high) & once, lengths)].view(np.int64)
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[at : at + 50_000, c])) for c in range(3)], ["key", "node", "label"])

    packed = nodes.mapInArrow(pack, "r int, pack binary")
    return packed.repartition(ranges, "r").sortWithinPartitions("r").mapInArrow(find, "key long, node long, label long").distinct()


def exact_candidates(found: DataFrame, points: DataFrame, t: int) -> DataFrame:
    """Pairs of nodes of different components that share a bucket and whose points allow the similarity.

    A bucket of more than ``BLOCK`` nodes is worked in pairs of blocks, each a task's group, so no bucket is held whole. Buckets of one
    tree leaf are bounded together, a few thousand pairs in one array operation. A pair that several buckets hold comes from the
    first of them: each node carries its first ``SEEN`` buckets, and a pair waits if both carry an earlier one.
    """
    size = found.groupBy("key").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = spread_join(found, staged(size, "sizes"), ["key"], "m", F.col("node")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("x"), F.greatest(F.col("own"), o).alias("y")))
    rows = rows.select("key", "node", "label", "own", F.explode(pairs).alias("p")).select("key", "node", "label", "own", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    seen = found.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, SEEN).alias("seen"))
    rows = rows.join(staged(points.join(seen, "node"), "carried"), "node")

    def survives(a: np.ndarray, b: np.ndarray, total: int) -> bool:
        return len(a) == GROUPS or len(b) == GROUPS or (100 + t) * fine_bound(a, b) >= t * total

    def first(a: list[int], b: list[int], key: int) -> bool:
        return not any(k < key for k in set(a).intersection(b))

    def leaves(held: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
        """Survivors among the pairs of buckets that are single leaves; a pair of several buckets is bounded once."""
        number: dict[int, int] = {}
        rows: list[tuple] = []
        for _, members in held:
            for m in members:
                if m[0] not in number:
                    number[m[0]] = len(rows)
                    rows.append(m)
        pairs: dict[tuple[int, int], int] = {}
        for key, members in sorted(held, key=lambda x: x[0], reverse=True):
            for i, u in enumerate(members):
                for v in members[:i]:
                    if u[1] != v[1]:
                        p, q = number[u[0]], number[v[0]]
                        pairs[(p, q) if p < q else (q, p)] = key
        if not pairs:
            return link_batch([])
        at = np.array(list(pairs))
        sizes = np.array([r[3] for r in rows])
        fine = [np.frombuffer(r[4], dtype=np.uint16) for r in rows]
        points = np.array([folded(p) for p in fine])
        low, high = np.sort(sizes[at], axis=1).T
        at, low, high = (x[100 * low >= t * high] for x in (at, low, high))
        bound = np.minimum(points[at[:, 0]], points[at[:, 1]]).sum(axis=1, dtype=np.int64)
        nodes = [r[0] for r in rows]
        return link_batch([(min(a, b), max(a, b)) for i, j in at[(100 + t) * bound >= t * (low + high)].tolist() for a, b in [(nodes[i], nodes[j])] if first(rows[i][5], rows[j][5], pairs[i, j]) and survives(fine[i], fine[j], sizes[i] + sizes[j])])

    def run(batches):
        held, n = [], 0
        for (key, x, y), members in grouped(batches, ["key", "x", "y"], ["node", "label", "own", "n", "point", "seen"]):
            if x == y and len(members) <= LEAF:
                held.append((key, members))
                n += len(members) * (len(members) - 1) // 2
                if n > 20_000:
                    yield leaves(held)
                    held, n = [], 0
                continue
            nodes, labels = np.array([m[0] for m in members]), np.array([m[1] for m in members])
            sides, sizes = np.array([m[2] for m in members]), np.array([m[3] for m in members])
            fine = [np.frombuffer(m[4], dtype=np.uint16) for m in members]
            vectors = np.array([folded(p) for p in fine])
            right = np.flatnonzero(sides == y)
            if not len(right) or len(np.unique(labels)) < 2:
                continue
            tree, out = CountTree(vectors[right], sizes[right], t), set()
            for i in np.flatnonzero(sides == x).tolist():
                for j in right[tree.search(vectors[i], int(sizes[i]))].tolist():
                    if labels[i] != labels[j] and first(members[i][5], members[j][5], key) and survives(fine[i], fine[j], sizes[i] + sizes[j]):
                        out.add((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
            yield link_batch(sorted(out))
        if held:
            yield leaves(held)

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, LINK).distinct()


def verified(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, t: int, width: int) -> DataFrame:
    """The pairs whose sets have the similarity. The two sets of a pair meet by the pair's number."""
    numbered = pairs.select("a", "b", F.xxhash64("a", "b").alias("pair"))
    ends = numbered.select(F.col("a").alias("node"), "pair", F.lit(0).alias("end")).unionByName(numbered.select(F.col("b").alias("node"), "pair", F.lit(1).alias("end")))
    rows = with_sets(docs, id_col, text_col, ends.groupBy("node").agg(F.collect_list(F.struct("pair", "end")).alias("ends")), width, "ends", "pair long, end int")

    def run(batches):
        for _, two in grouped(batches, ["pair"], ["node", "shingles"]):
            if len(two) == 2:
                a, b = (np.frombuffer(x[1], dtype=np.uint64) for x in two)
                yield link_batch([(two[0][0], two[1][0])] if linked(a, b, t) else [])

    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, LINK)


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, threshold: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The signatures, and ``(fp, label, component_id)`` of each set that isn't empty."""
    sigs = signatures(docs, id_col, text_col, threshold, width)
    full = sigs.where("n > 0")
    classes = staged(full.groupBy("fp").agg(F.min("k").alias("node"), F.min("id").alias("least")), "classes")
    reps = staged(full.dropDuplicates(["k"]).join(classes.select("node"), F.col("k") == F.col("node"), "left_semi").select(F.col("k").alias("node"), "n", "first", "prefix", "point"), "nodes")
    links = staged(first_round(docs, reps, id_col, text_col, threshold, width).distinct(), "first")
    label = components(links)
    total = reps.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    named = reps.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "prefix")
    found = staged(open_buckets(named, int(total)), "open")
    pairs = staged(exact_candidates(found, reps.select("node", "n", "point"), threshold), "pairs")
    more = staged(verified(docs, id_col, text_col, pairs, threshold, width), "second")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    named = classes.join(label, "node", "left").select("fp", "least", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return sigs, named.join(least, "label").select("fp", "label", "component_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, width: int = 5) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links of similarity ``threshold`` / 100 or more.

    Words are compared with A-Z lower-cased; fewer than ``width`` words are one shingle. A
    null or wordless text has 0 shingles and is linked with nothing. Rows alike in id and
    text are one document; rows of one id with different texts are different documents.
    Null ids never name a component that holds another id. Other columns are not read.
    """
    sigs, classes = labelled_rows(docs, id_col, text_col, threshold, width)
    out = sigs.where("n > 0").select("fp", F.col("id").alias(id_col), F.col("n").alias("n_shingles")).join(classes, "fp").select(id_col, "n_shingles", "component_id")
    rest = sigs.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(rest)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id, null last.

    Wordless texts (null, empty, white space) stay. Rows alike in id and text become one, whichever of them; ties of id go
    by a hash of the text. An empty table stays empty, columns of any name pass through.
    """
    sigs, classes = labelled_rows(docs, id_col, text_col, threshold, width)
    (key,) = fresh(docs.columns, "key")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("k"))
    first = sigs.where("n > 0").join(classes, "fp").groupBy("label").agg(F.min(order).alias("x")).select(F.col("x.k").alias(key))
    kept = staged(first.unionByName(sigs.where("n = 0").select(F.col("k").alias(key))).distinct(), "kept")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)

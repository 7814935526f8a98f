"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

The model predicts a token from the two before it: ``r = C1 x[w-1] + C2 x[w-2]`` scores first a group of tokens,
``r . t[g] + c[g]``, then a token in the group, ``r . q[w] + b[w]``; both normalisers are sums over all alternatives,
the first from products of contexts' exponentials, the second from batched matrix products. The vocabulary grows
with the corpus: about ``2 sqrt(N)`` tokens of N have parameters of their own. The most frequent are groups by
themselves, the others share groups by rank, as many as each holds. Tokens beyond are grouped by their last three
bytes and have their add-one relative frequency in the group. So every token has a normalised probability, met in
training or not.

Training is numpy, on all training texts, in synchronous rounds. Texts are dealt to rounds and shards by
hash. In a round each shard starts from the same parameters and makes steps of noise-contrastive estimation; the
parameters are averaged, each row weighted by how often the shard met it, and start the next round. Nothing
of this follows the partitions of the table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, staged, tidy
from .jaccard_join import grouped

#: Tokens that are groups by themselves, groups of tokens without parameters, dimensions.
TOP, TAILS, DIM = 256, 128, 16
#: Most positions of a training step, noise groups of a step, noise tokens of a position, rounds, tokens of the shard of a small corpus.
BATCH, NOISE, PEERS, ROUNDS, SHARD = 1024, 64, 3, 8, 250_000
#: Tokens whose counts every task gets (those above go through a join); longer ones than so many bytes go by a digest.
FREQUENT, LONGEST = 200_000, 64
SORT = 1_000_000
#: Packs that rows are cut into at once.
FAN = 4096
#: Positions that are scored at once, groups of which contexts' exponentials are held at once, pairs or positions worked at once, largest exponent of a factor.
WINDOW, COLUMNS, BLOCK, STEEP = 1 << 19, 64, 2048, 40
END = b""


def parts_of(batches, size: int):
    """Slices of Arrow batches, at most ``size`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    tidy()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bytes_of(words: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls; ``to_pylist`` makes a scalar of each first."""
    if not len(words):
        return []
    at, data = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].tolist(), words.buffers()[2]
    data = data.slice(at[0], at[-1] - at[0]).to_pybytes() if data else b""
    return [data[x - at[0] : y - at[0]] for x, y in zip(at[:-1], at[1:], strict=True)]


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, which of them each token is, each text's followed by an end, and how many each text has.

    Arrow splits and numbers the words, so that no token is a Python object. Long ones stand as digests.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    words, found = coded.dictionary.cast(pa.large_binary()).cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False)
    end = pc.index(words, pa.scalar(END, pa.binary())).as_py()
    if end < 0:  # else a text begins or ends with a space or is empty, which gives empty strings
        end, words = len(words), pa.concat_arrays([words, pa.array([END], pa.binary())])
    real = found != end
    sizes = np.bincount(owner[real], minlength=len(texts)).astype(np.int64) + 1
    which = np.full(sizes.sum(), end, dtype=np.int64)
    inner = np.ones(len(which), dtype=bool)
    inner[np.cumsum(sizes) - 1] = False
    which[inner] = found[real]
    if pc.max(pc.binary_length(words)).as_py() > LONGEST:
        words = pa.array([w if len(w) <= LONGEST else b"\x00" + xxhash.xxh3_128_digest(w) for w in bytes_of(words)], pa.binary())
    return words, which, sizes


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def token_counts(docs: DataFrame) -> DataFrame:
    """``(h, word, c)`` over the training texts. Tasks count first and pass on a row for each token they met."""

    def merged(held: list) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def out(met: pa.Table):
        for rows in met.to_batches(20_000):
            words = column(rows, "word")
            yield pa.RecordBatch.from_arrays([pa.array([signed(xxhash.xxh3_64_intdigest(x)) for x in bytes_of(words)], pa.int64()), words, column(rows, "c")], ["h", "word", "c"])

    def run(batches):
        held, size = [], 0
        for rows in parts_of(batches, 1024):
            words, which, _ = tokens_of(column(rows, "t"))
            held.append(pa.table({"word": words, "c": np.bincount(which, minlength=len(words))}))
            size += len(words)
            if size > 800_000:
                held = [merged(held)]
                size = len(held[0])
                if size > 400_000:
                    yield from out(held[0])
                    held, size = [], 0
        if held:
            yield from out(merged(held))

    rows = docs.where(~F.col("held_out")).select("t").mapInArrow(run, "h long, word binary, c long")
    return staged(rows.groupBy("h", "word").agg(F.sum("c").alias("c")), "counts")


def own_tokens(total: int) -> int:
    """How many tokens have parameters of their own in a corpus of so many."""
    return min(FREQUENT, TOP + math.ceil(2 * math.sqrt(total)))


def batch_of(total: int) -> int:
    """Positions of a training step: fewer in a small corpus, which else gave too few steps."""
    return min(BATCH, max(64, total // 1000))


class Vocabulary:
    """What every task knows: the frequent tokens with counts, the units of the model, and totals of the tail groups.

    A unit is a token with own parameters (by rank) or, after those, a tail. Groups are the ``TOP`` first
    units, then runs of ``size`` units, then the tails.
    """

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, tails: dict[int, tuple[int, int]]):
        self.words = words
        self.total, self.distinct = total, distinct
        c = np.array(counts, dtype=np.float64)
        self.own = own = min(len(words), own_tokens(total))
        self.base = np.log10((c + 1) / (total + distinct + 1))
        self.units = np.array([i if i < own else self.tail(w) for i, w in enumerate(words)], dtype=np.int64)
        tail = np.zeros((TAILS, 2))
        for k, v in tails.items():
            tail[k] = v
        for w, n in zip(words[:own], counts[:own], strict=True):
            tail[zlib.crc32(w[-3:]) % TAILS] -= (n, 1)
        self.tail_log = np.log10(tail.sum(axis=1) + 1)  # log10(N_r + V_r + 1)
        self.within = np.where(np.arange(len(words)) < own, 0.0, np.log10(c + 1) - self.tail_log[np.maximum(self.units - own, 0)])
        self.size = max(1, math.ceil(math.sqrt(own)))
        rank = np.arange(own)
        runs = -(-max(0, own - TOP) // self.size)
        self.first_tail = min(own, TOP) + runs
        self.group = np.concatenate([np.where(rank < TOP, rank, TOP + (rank - TOP) // self.size), self.first_tail + np.arange(TAILS)]).astype(np.int64)
        self.groups = self.first_tail + TAILS
        share = np.concatenate([c[:own], np.maximum(0, tail[:, 0])]) + 1
        self.group_share = np.bincount(self.group, weights=share, minlength=self.groups)
        self.unit_share = share[:own] / self.group_share[self.group[:own]]  # of a unit in its group
        self.group_share /= self.group_share.sum()
        self.array: pa.Array | None = None

    def tail(self, word: bytes) -> int:
        return self.own + zlib.crc32(word[-3:]) % TAILS

    @property
    def start(self) -> int:
        """The context before a text."""
        return self.own + TAILS

    def indexed(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Number among the frequent tokens (-1: none) and unit of each of some tokens; places of the others, and these."""
        if self.array is None:
            self.array = pa.array(self.words, pa.binary())
        idx = pc.index_in(words, value_set=self.array).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = np.flatnonzero(idx < 0)
        others = bytes_of(words.take(pa.array(rare)))
        units = self.units[idx] if len(self.words) else np.zeros(len(idx), dtype=np.int64)
        units[rare] = [self.tail(w) for w in others]
        return idx, units, rare, others


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Sums over all counts; the driver gets ``FREQUENT`` tokens and one row for each tail."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    levels = counts.withColumn("level", F.floor(F.log2("c") * 16))
    # the lowest level of counts from which at most so many tokens are left; levels are a few hundred
    least, left = 0, FREQUENT
    for level, n in sorted(map(tuple, levels.groupBy("level").agg(F.count("*")).collect()), reverse=True):
        left -= n
        if left < 0:
            least = level + 1
            break
    top = levels.where((F.col("level") >= least) | (F.length("word") == 0)).select("word", "c").collect()
    top.sort(key=lambda r: (len(r[0]) > 0, -r[1], r[0]))
    tail = (F.crc32(F.substring("word", -3, 3)) % TAILS).cast("int")
    tails = {r[0]: (r[1], r[2]) for r in counts.groupBy(tail.alias("r")).agg(F.sum("c"), F.count("*")).collect()}
    return Vocabulary([bytes(r[0]) for r in top], [r[1] for r in top], total or 0, distinct, tails)


class LogBilinear:
    """Parameters as rows: x (contexts), q (units, bias last), t (groups, bias last), c (C1 over C2), each with one Adagrad sum a row.

    ``met`` counts for each row in how many steps or samples it took part since the start of the round.
    """

    def __init__(self, vocab: Vocabulary, rows: list[np.ndarray], sums: list[np.ndarray]):
        self.v, self.rows, self.sums = vocab, rows, sums
        self.met = [np.zeros(len(r), dtype=np.float32) for r in rows]
        self.x, self.q, self.t, self.c = rows
        self.spare: dict[int, tuple] = {}  # sums of a step, all 0 between steps

    @staticmethod
    def shapes(vocab: Vocabulary) -> list[tuple[int, int]]:
        return [(vocab.start + 1, DIM), (vocab.own, DIM + 1), (vocab.groups, DIM + 1), (2 * DIM, DIM)]

    @classmethod
    def begin(cls, vocab: Vocabulary, seed: int) -> LogBilinear:
        rng = np.random.default_rng(seed)
        rows = [rng.normal(0, 0.1, shape).astype(np.float32) for shape in cls.shapes(vocab)]
        rows[1][:, DIM] = np.log(vocab.unit_share)
        rows[2][:, DIM] = np.log(vocab.group_share)
        rows[3][:] = np.concatenate([np.eye(DIM), 0.5 * np.eye(DIM)])
        return cls(vocab, rows, [np.full(len(r), 1e-3, dtype=np.float32) for r in rows])

    def packed(self) -> np.ndarray:
        """All rows as one array, each row with its sum and followed by what it met, rows and sums times that."""
        return np.concatenate([np.concatenate([np.column_stack([r, s]) * m[:, None], m[:, None]], axis=1).ravel() for r, s, m in zip(self.rows, self.sums, self.met, strict=True)])

    def averaged(self, packed: np.ndarray) -> LogBilinear:
        """The model of rows averaged by what they met; rows that none met stay."""
        rows, sums, at = [], [], 0
        for r, s in zip(self.rows, self.sums, strict=True):
            part = packed[at : at + len(r) * (r.shape[1] + 2)].reshape(len(r), -1)
            at += part.size
            m = part[:, -1:]
            mean = np.where(m > 0, part[:, :-1] / np.maximum(m, 1e-30), np.column_stack([r, s]))
            rows.append(mean[:, :-1].astype(np.float32))
            sums.append(mean[:, -1].astype(np.float32))
        return LogBilinear(self.v, rows, sums)

    def update(self, which: int, at: np.ndarray | None, grads: np.ndarray, rate: float) -> None:
        """Adagrad over the rows ``at`` (None: all in order), some of which recur."""
        rows, sums = self.rows[which], self.sums[which]
        if at is None:
            sums += np.einsum("nd,nd->n", grads, grads) / grads.shape[1]
            rows += (rate / np.sqrt(sums))[:, None] * grads
            self.met[which] += 1
            return
        if which not in self.spare:
            self.spare[which] = np.zeros(rows.shape, dtype=np.float32), np.zeros(len(rows), dtype=bool), np.arange(rows.shape[1])
        total, touched, cols = self.spare[which]
        np.add.at(total.reshape(-1), ((at * rows.shape[1])[:, None] + cols).reshape(-1), grads.reshape(-1))
        np.add.at(self.met[which], at, np.float32(1))
        touched[at] = True
        u = np.flatnonzero(touched)
        touched[u] = False
        g = total.take(u, 0)
        total[u] = 0
        mean = sums.take(u) + np.einsum("nd,nd->n", g, g) / g.shape[1]
        sums[u] = mean
        g *= (rate / np.sqrt(mean))[:, None]
        rows[u] = rows.take(u, 0) + g

    def train(self, seed: int, rate: float):
        """A coroutine: ``send((w, p1, p2))`` makes one step on the contrastive objective of both levels.

        Noise groups are drawn by share and shared by the step; noise units evenly from the group, whose members
        are neighbours by rank.
        """
        v, rng = self.v, np.random.default_rng(seed)
        cum = np.cumsum(v.group_share)
        noise_log = np.log(NOISE * v.group_share).astype(np.float32)
        first = TOP + (np.arange(v.groups) - TOP) * v.size  # first unit of each group of several
        members = np.maximum(1, np.minimum(first + v.size, v.own) - first)
        peer_log = np.log(PEERS / members).astype(np.float32)
        while True:
            w, p1, p2 = yield
            x1, x2 = self.x.take(p1, 0), self.x.take(p2, 0)
            r1 = np.ones((len(w), DIM + 1), dtype=np.float32)
            r1[:, :DIM] = x1 @ self.c[:DIM] + x2 @ self.c[DIM:]
            g = v.group.take(w)
            z = np.minimum(np.searchsorted(cum, rng.random(NOISE)), v.groups - 1)
            tg, tz = self.t.take(g, 0), self.t.take(z, 0)
            up = logistic(noise_log.take(g) - np.einsum("nd,nd->n", r1, tg))
            down = -logistic(r1 @ tz.T - noise_log[z])
            dr = up[:, None] * tg[:, :DIM] + down @ tz[:, :DIM]
            self.update(2, np.concatenate([g, z]), np.concatenate([up[:, None] * r1, down.T @ r1]), rate)
            inside = np.flatnonzero((w >= TOP) & (w < v.own))
            if len(inside):
                wi, ri, gi = w.take(inside), r1.take(inside, 0), g.take(inside)
                peers = first.take(gi)[:, None] + (rng.random((len(wi), PEERS), dtype=np.float32) * members.take(gi)[:, None]).astype(np.int64)
                both = np.concatenate([wi[:, None], peers], axis=1)
                qs = self.q.take(both.ravel(), 0).reshape(len(wi), PEERS + 1, DIM + 1)
                slope = np.einsum("nd,njd->nj", ri, qs) - peer_log.take(gi)[:, None]
                slope[:, 0] *= -1
                slope = logistic(slope)
                slope[:, 1:] *= -1
                dr[inside] += np.einsum("nj,njd->nd", slope, qs[:, :, :DIM])
                self.update(1, both.ravel(), (slope[:, :, None] * ri[:, None, :]).reshape(-1, DIM + 1), rate)
            dc = np.concatenate([x1.T @ dr, x2.T @ dr])
            self.update(0, np.concatenate([p1, p2]), np.concatenate([dr @ self.c[:DIM].T, dr @ self.c[DIM:].T]), rate)
            self.update(3, None, dc, rate)

    def log_probs(self, w: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Natural log of the probability of units (for a tail: of all its tokens together), normalised over all alternatives of both levels."""
        v, out, size = self.v, np.empty(len(w)), self.v.start + 1
        one, two = self.x @ self.c[:DIM], self.x @ self.c[DIM:]
        for at in range(0, len(w), WINDOW):
            s = slice(at, at + WINDOW)
            pairs, place = np.unique(p1[s] * size + p2[s], return_inverse=True)
            r = np.ones((len(pairs), DIM + 1), dtype=np.float32)
            r[:, :DIM] = one.take(pairs // size, 0) + two.take(pairs % size, 0)
            norm = self.group_norms(one, two, pairs // size, pairs % size, r)
            g = v.group.take(w[s])
            for low in range(0, len(g), BLOCK):
                i = slice(low, low + BLOCK)
                out[at:][i] = np.einsum("nd,nd->n", r.take(place[i], 0), self.t.take(g[i], 0)) - norm[place[i]]
            inside = np.flatnonzero((w[s] >= TOP) & (w[s] < v.own))
            inside = inside[np.argsort(g[inside], kind="stable")]
            cuts = np.flatnonzero(np.diff(g[inside], prepend=-1, append=-1)) if len(inside) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                low = TOP + (g[inside[a]] - TOP) * v.size
                q = self.q[low : min(low + v.size, v.own)].T
                for begin in range(a, b, BLOCK):
                    i = inside[begin : min(begin + BLOCK, b)]
                    scores = r.take(place[i], 0) @ q
                    out[at + i] += scores[np.arange(len(i)), w[at + i] - low] - log_sum(scores)
        return out

    def group_norms(self, one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
        """log of the sum over groups of exp(r . t), r being ``one[a] + two[b]`` and a 1 for the bias.

        exp of the sum is the product of exp(one[a] . t) and exp(two[b] . t), so exponentials are taken for each context, not for each pair. Pairs
        with a factor too steep for that are summed by themselves.
        """
        total, sides = np.zeros(len(a)), []
        for x, of, bias in ((one, a, 1), (two, b, 0)):
            seen = np.zeros(len(x), dtype=bool)
            seen[of] = True
            met, place = np.flatnonzero(seen), (np.cumsum(seen) - 1)[of]
            sides.append((np.column_stack([x.take(met, 0), np.full(len(met), bias, dtype=np.float32)]), place, np.zeros(len(met), dtype=bool)))
        for low in range(0, len(self.t), COLUMNS):
            t, factors = np.ascontiguousarray(self.t[low : low + COLUMNS].T), []
            for x, _, steep in sides:
                scores = x @ t
                steep |= (scores.max(axis=1) > STEEP) | (scores.min(axis=1) < -STEEP)
                np.clip(scores, -STEEP, STEEP, out=scores)
                factors.append(np.exp(scores, out=scores))
            for at in range(0, len(a), BLOCK):
                s = slice(at, at + BLOCK)
                total[s] += np.einsum("nd,nd->n", *(f.take(place[s], 0) for f, (_, place, _) in zip(factors, sides, strict=True)))
        out = np.log(total)
        alone = np.flatnonzero(sides[0][2][sides[0][1]] | sides[1][2][sides[1][1]])
        for at in range(0, len(alone), BLOCK):
            i = alone[at : at + BLOCK]
            out[i] = log_sum(r[i] @ self.t.T)
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def log_sum(scores: np.ndarray) -> np.ndarray:
    """log of the sum of exp along rows. Rows whose largest score is beyond what exp can hold are shifted first."""
    top = scores.max(axis=1)
    top[np.abs(top) <= 80] = 0
    if top.any():
        scores = scores - top[:, None]
    return np.log(np.exp(scores) @ np.ones(scores.shape[1], dtype=scores.dtype)) + top


def contexts(units: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that, ``start`` before a text."""
    starts = np.cumsum(sizes) - sizes
    p1 = np.concatenate([[start], units[:-1]])
    p1[starts] = start
    p2 = np.concatenate([[start], p1[:-1]])
    p2[starts] = start
    return p1, p2


TABLE = "r int, pack binary, round int, shard int, key long, row long, id long, held_out boolean, n_tokens long, n_known long, base double, part double, units binary"


def dealt(docs: DataFrame, sent, shards: int, ranges: int) -> DataFrame:
    """A table in the shared folder, sorted by round: a row for each text with its units, its round and shard by hash and what
    frequent tokens give (``part``: their log10 share of their tails), and rows with packs of (hash, row, tail) of all other tokens."""
    names, step = [x.split()[0] for x in TABLE.split(", ")], -(-ranges // FAN)
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in TABLE.split(", ")]

    def table_batch(n: int, **columns) -> pa.RecordBatch:
        arrays = [columns.get(c) for c in names]
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if a is None else a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names)

    def run(batches):
        vocab, rare_rows = sent.value, []

        def rare_batch():
            at, data = packs(np.concatenate(rare_rows), ranges, step)
            rare_rows.clear()
            return table_batch(len(at), r=at, pack=data)

        for rows in parts_of(batches, 512):
            words, which, sizes = tokens_of(column(rows, "t"))
            idx, units, rare, others = vocab.indexed(words)
            hashes = np.zeros(len(words), dtype=np.int64)
            hashes[rare] = [signed(xxhash.xxh3_64_intdigest(w)) for w in others]
            idx, units = idx[which], units[which]
            owner = np.repeat(np.arange(rows.num_rows), sizes)
            known = idx >= 0
            freq, mine = idx[known], owner[known]
            total = lambda x: np.bincount(mine, weights=x, minlength=rows.num_rows)  # noqa: B023, E731
            slots = column(rows, "key").to_numpy() % (ROUNDS * shards)
            yield table_batch(
                rows.num_rows, round=slots % ROUNDS, shard=slots // ROUNDS, **{c: column(rows, c) for c in ("key", "row", "id", "held_out")}, n_tokens=sizes,
                n_known=np.bincount(mine, minlength=rows.num_rows), base=total(vocab.base[freq]), part=total(vocab.within[freq]), units=[u.tobytes() for u in np.split(units.astype(np.int32), np.cumsum(sizes)[:-1])],
            )
            rare = np.flatnonzero(~known)
            if len(rare):
                rare_rows.append(np.column_stack([hashes[which[rare]], column(rows, "row").to_numpy()[owner[rare]], units[rare] - vocab.own]))
                if sum(map(len, rare_rows)) > 400_000:
                    yield rare_batch()
        if rare_rows:
            yield rare_batch()

    rows = docs.select(F.xxhash64("id", "t").alias("key"), F.monotonically_increasing_id().alias("row"), "id", "held_out", "t")
    return staged(rows.mapInArrow(run, TABLE).sortWithinPartitions("round"), "units")


def shards_of(total: int) -> int:
    """Shards of a round: their number grows as the root of the corpus, as the parameters do, so what is averaged grows in proportion."""
    return max(1, round(math.sqrt(total / ROUNDS / SHARD)))


def trained(table: DataFrame, sent, shards: int, seed: int) -> LogBilinear:
    """The model after all rounds. A round's parameters meet in a few tasks, then on the driver: two arrays of bounded size."""
    vocab = sent.value
    model, sc = LogBilinear.begin(vocab, seed), table.sparkSession.sparkContext
    for number in range(ROUNDS):
        given = sc.broadcast((model.rows, model.sums))
        rate = 0.12 * (1 - number / (ROUNDS + 2))

        def run(batches, given=given, number=number, rate=rate):
            vocab, last, local, steps, held, size = sent.value, None, None, None, [], 0
            batch = batch_of(vocab.total)

            def done():
                if held:
                    feed(steps, held, vocab.start, seed + number, batch)
                return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([local.packed().tobytes()], pa.large_binary())], ["shard", "flat"])

            for shard_ids, packs_ in rows_of(batches, ["shard", "units"], 256):
                for shard, pack in zip(shard_ids, packs_, strict=True):
                    if shard != last:
                        if last is not None:
                            yield done()
                        last, held, size = shard, [], 0
                        rows, sums = given.value
                        local = LogBilinear(vocab, [r.copy() for r in rows], [s.copy() for s in sums])
                        steps = local.train(seed + 1000 * number + shard, rate)
                        next(steps)
                    held.append(pack)
                    size += len(pack) // 4
                    if size >= 16 * BATCH:
                        feed(steps, held, vocab.start, seed + number, batch)
                        size = 0
            if last is not None:
                yield done()

        def add(batches):
            total, low = None, None
            for ids, flats in rows_of(batches, ["shard", "flat"], 1):
                part = np.frombuffer(flats[0], dtype=np.float32).astype(np.float64)
                total, low = (part, ids[0]) if total is None else (total + part, min(low, ids[0]))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.large_binary())], ["shard", "flat"])

        schema = "shard int, flat binary"
        mine = table.where((F.col("round") == number) & ~F.col("held_out")).select("shard", "key", "units")
        found = mine.repartition(shards, "shard").sortWithinPartitions("shard", "key").mapInArrow(run, schema)
        for fold in ([math.ceil(math.sqrt(shards))] if shards > 8 else []) + [2]:
            found = found.withColumn("to", F.col("shard") % fold).repartition(fold, "to").sortWithinPartitions("to", "shard").drop("to").mapInArrow(add, schema)
        parts = sorted(found.collect(), key=lambda r: r[0])
        if parts:
            model = model.averaged(sum(np.frombuffer(r[1], dtype=np.float32).astype(np.float64) for r in parts))
        given.destroy()
    return model


def feed(steps, held: list[bytes], start: int, seed: int, batch: int) -> None:
    """Steps over the positions of the held texts in random order; a batch mixes texts."""
    w = np.frombuffer(b"".join(held), dtype=np.int32).astype(np.int64)
    p1, p2 = contexts(w, np.array([len(h) // 4 for h in held]), start)
    held.clear()
    order = np.random.default_rng(seed + len(w)).permutation(len(w))
    for at in range(0, len(w), batch):
        o = order[at : at + batch]
        steps.send((w[o], p1[o], p2[o]))


def packs(rows: np.ndarray, ranges: int, step: int = 1) -> tuple[list[int], list[bytes]]:
    """Rows of 64-bit numbers cut by the range of the first; ``step`` ranges together are one pack."""
    where = (rows[:, 0].view(np.uint64) % np.uint64(ranges)).astype(np.int64) // step
    order = np.argsort(where, kind="stable")
    rows, where = rows[order], where[order]
    at, cuts = np.unique(where, return_index=True)
    return (at * step).tolist(), [part.tobytes() for part in np.split(rows, cuts[1:])] if len(rows) else []


def by_range(df: DataFrame, ranges: int, width: int) -> DataFrame:
    """Packs ``(r, pack)`` dealt to their ranges and sorted. Beyond ``FAN`` ranges packs of several are dealt first and cut anew, so that
    none gets tiny."""
    if ranges > FAN:
        step = -(-ranges // FAN)

        def cut(batches):
            held, size = [], 0
            for (data,) in rows_of(batches, ["pack"]):
                held += [np.frombuffer(d, dtype=np.int64).reshape(-1, width) for d in data]
                size += sum(map(len, data)) // 8 // width
                if size > 500_000:
                    yield pack_batch(np.concatenate(held), ranges)
                    held, size = [], 0
            if held:
                yield pack_batch(np.concatenate(held), ranges)

        df = df.repartition(-(-ranges // step), "r").mapInArrow(cut, "r int, pack binary")
    return df.repartition(ranges, "r").sortWithinPartitions("r")


def pack_batch(rows: np.ndarray, ranges: int, step: int = 1) -> pa.RecordBatch:
    at, data = packs(rows, ranges, step)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["r", "pack"])


def scored(table: DataFrame, sent, model) -> DataFrame:
    """The texts of the table with the log10 probability of their units, ``part`` included."""
    fields = "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        vocab, lbl = sent.value, LogBilinear(sent.value, *model.value)
        for batch in batches:
            ends = np.cumsum(pc.binary_length(column(batch, "units")).to_numpy() // 4)
            cuts = np.flatnonzero(np.diff((ends - 1) // WINDOW, prepend=-1, append=-1)) if len(ends) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(low, high - low)
                data = column(rows, "units").to_pylist()
                sizes = np.array([len(u) // 4 for u in data])
                units = np.frombuffer(b"".join(data), dtype=np.int32).astype(np.int64)
                logs = lbl.log_probs(units, *contexts(units, sizes, vocab.start))
                score = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=logs, minlength=len(sizes)) / math.log(10) + column(rows, "part").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(score) if c == "score" else column(rows, c) for c in names], names)

    return table.where("units is not null").select(*names[:-1], "part", "units").mapInArrow(run, fields)


def rare_part(table: DataFrame, counts: DataFrame, sent, ranges: int) -> DataFrame:
    """``(row, n_known, base, score)`` of the tokens outside the frequent ones, summed per text.

    Counts and tokens meet by hash range; a range is sorted and searched as an array. The sums of each range
    then meet by text, again as arrays of which one row travels for each pair of ranges.
    """

    step = -(-ranges // FAN)

    def pack_counts(batches):
        for hashes, numbers in rows_of(batches, ["h", "c"], 200_000):
            if hashes:
                yield pack_batch(np.array([hashes, numbers, [-1] * len(hashes)], dtype=np.int64).T.copy(), ranges, step)

    def look_up(batches):
        vocab = sent.value
        for _, rows in grouped(batches, ["r"], ["pack"]):
            x = np.concatenate([np.frombuffer(p[0], dtype=np.int64).reshape(-1, 3) for p in rows])
            table, asked = x[x[:, 2] < 0], x[x[:, 2] >= 0]
            if not len(asked):
                continue
            table = table[np.argsort(table[:, 0])]
            c = np.zeros(len(asked))
            if len(table):
                at = np.minimum(np.searchsorted(table[:, 0], asked[:, 0]), len(table) - 1)
                c = np.where(table[at, 0] == asked[:, 0], table[at, 1], 0).astype(float)
            row, owner = np.unique(asked[:, 1], return_inverse=True)
            out = np.empty((len(row), 4), dtype=np.int64)
            out[:, 0] = row
            out[:, 1] = np.bincount(owner, weights=c > 0)
            out[:, 2] = np.bincount(owner, weights=np.log10((c + 1) / (vocab.total + vocab.distinct + 1))).view(np.int64)
            out[:, 3] = np.bincount(owner, weights=np.log10(c + 1) - vocab.tail_log[asked[:, 2]]).view(np.int64)
            yield pack_batch(out, ranges, step)

    def add_up(batches):
        for _, rows in grouped(batches, ["r"], ["pack"]):
            x = np.concatenate([np.frombuffer(p[0], dtype=np.int64).reshape(-1, 4) for p in rows])
            row, owner = np.unique(x[:, 0], return_inverse=True)
            sums = [np.bincount(owner, weights=w) for w in (x[:, 1], np.ascontiguousarray(x[:, 2]).view(np.float64), np.ascontiguousarray(x[:, 3]).view(np.float64))]
            for at in range(0, len(row), 50_000):
                s = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(row[s]), pa.array(sums[0][s].astype(np.int64)), pa.array(sums[1][s]), pa.array(sums[2][s])], ["row", "n_known", "base", "score"])

    asked = table.where("r is not null").select("r", "pack")
    both = asked.unionByName(counts.select("h", "c").mapInArrow(pack_counts, "r int, pack binary"))
    sums = by_range(both, ranges, 3).mapInArrow(look_up, "r int, pack binary")
    return by_range(sums, ranges, 4).mapInArrow(add_up, "row long, n_known long, base double, score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, seed: int = 11) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Learned from the rows whose crc32 of the id as text (null: empty text) leaves another remainder than ``held``.
    ``base_score`` is the add-one unigram log10 probability, ``score`` the model's. A null or
    empty text is its end token alone. Repeated rows each get a result; with no training rows all counts are 0.
    Other columns are not read.

    The same rows give the same model, however they are partitioned.

    Scale: two passes over the texts (count, deal); training and scoring read the dealt units. What tasks share is bounded: 200,000 tokens of
    at most 64 bytes (longer ones go by a digest of 17) and the parameters of at most as many. All other tokens are looked up by hash range.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == held
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), held_out.alias("held_out"))
    sc = docs.sparkSession.sparkContext
    counts = token_counts(rows)
    vocab = vocabulary(counts)
    sent = sc.broadcast(vocab)
    ranges, shards = max(1, -(-(vocab.total // 8) // SORT)), shards_of(vocab.total)
    table = dealt(rows, sent, shards, ranges)
    model = trained(table, sent, shards, seed)
    own = scored(table, sent, sc.broadcast((model.rows, model.sums)))
    rare = rare_part(table, counts, sent, ranges).select("row", *[F.col(c).alias(f"{c}2") for c in ("n_known", "base", "score")])
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"{c}2"), F.lit(0))
    joined = own.join(rare, "row", "left")
    return joined.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("n_known").cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("score").alias("score"))

"""Byte-pair encoding and decoding with a minimal acyclic transducer as its lexicon.

Frequent words of the corpus are encoded once, on the driver, and compiled into a minimal
acyclic automaton with shared suffixes. Each arc carries the number of accepted words that
sort before it, so that the sum along a path is the word's number, and the number leads to
its ids. The automaton is one flat file that every executor maps into memory; words are
looked up in batches, one array operation for each byte position. Words that it does not
hold are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped_file, rows_of

#: White space as the tokenizer's regular expressions know it (fixed by Unicode).
BLANKS = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it is visible Latin-1, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in visible else spare))
        spare += b not in visible
    return letters


@functools.lru_cache(2)
def exact_classes(rule: str) -> regex.Pattern:
    """``rule`` with letters and numbers as of the interpreter's Unicode tables, which are the tokenizer's; those of ``regex`` are newer."""
    newer = {"L": [], "N": []}
    for kind, found in newer.items():
        known = regex.compile(rf"\p{{{kind}}}")
        for cp in range(0x530, 0x110000):
            c = chr(cp)
            if unicodedata.category(c)[0] != kind and known.match(c):
                if found and found[-1][1] == cp - 1:
                    found[-1][1] = cp
                else:
                    found.append([cp, cp])
    text = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in newer.items()}
    for kind, out in text.items():
        rule = rule.replace(rf"[\p{{{kind}}}]", rf"(?:(?![{out}])\p{{{kind}}})" if out else rf"\p{{{kind}}}")
    both = "".join(text.values())
    *first, others = rule.split("|")  # the last alternative is what is neither
    return regex.compile("|".join([*first, f"(?:{others[:-1]}|[{both}])+" if both else others]))


class WordBpe:
    """The tokenizer that a ``tokenizers`` JSON file describes: word splitting and merges.

    Supported: NFC, white space to one space, lower case, a split pattern, byte letters and
    byte-pair merges with a word-end sign; other settings raise ``ValueError``.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or model["type"] != "BPE" or pre[1]["add_prefix_space"] or pre[1]["use_regex"] or spec.get("decoder") or model["byte_fallback"] or model["unk_token"]:
            raise ValueError("this kind of tokenizer file is not supported")
        self.rule = pre[0]["pattern"]["Regex"].replace(r"\s", BLANKS.replace(r"\t-\r ", r"\t-\r\x20"))
        self.pattern = regex.compile(self.rule)
        self.far = regex.compile(r"[^\x00-\u052f]")
        self.blanks = regex.compile(f"[{BLANKS}]+")
        self.odd = "\x1c\x1d\x1e\x1f"  # white space to split() but not to the tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letter = {b: c for b, c in enumerate(byte_letters())}

    def normal(self, text: str) -> str:
        """NFC and lower case. A capital sigma becomes the common small one everywhere, as each character is taken alone."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """What stands between white space."""
        return [x for x in self.blanks.split(text) if x] if any(map(text.__contains__, self.odd)) else text.split()

    def words(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,!?;:":
            return [chunk[:-1], chunk[-1]]
        return (exact_classes(self.rule) if self.far.search(chunk) else self.pattern).findall(chunk)

    def merged(self, word: str) -> list[int]:
        """The ids of one word: its pairs merged, lowest rank first, leftmost among equals."""
        sym: list[str | None] = [self.letter[b] for b in word.encode()]
        sym[-1] += self.end
        sym = [s for s in sym if s in self.vocab]
        if len(sym) <= 48:
            self.merge_short(sym)
        else:
            self.merge_long(sym)
        return [self.vocab[s] for s in sym if s is not None]

    def merge_short(self, sym: list[str]) -> None:
        """Merge in place: the ranks of adjacent pairs in a list, its least each time."""
        none = len(self.rank)
        get = self.rank.get
        ranks = [get(p, none) for p in zip(sym, sym[1:])]  # noqa: B905
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            a = sym[i] = sym[i] + sym[i + 1]
            del sym[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((sym[i - 1], a), none)
            if i < len(ranks):
                ranks[i] = get((a, sym[i + 1]), none)

    def merge_long(self, sym: list[str | None]) -> None:
        """The same over a heap and a linked list, in n log n; merged-away places become None."""
        n, rank = len(sym), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if sym[i] != a or (j := right[i]) >= n or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (h := left[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The minimal acyclic transducer of ``entries`` (word to ids) as one flat file of 32-bit numbers.

    Layout: number of arcs, states, words and ids; then arcs sorted by (state, byte), as
    state, byte, target and words before it; whether a state accepts; where each word's ids
    begin; the ids.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items() if w)
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []
    accepts: list[bool] = []
    sizes: list[int] = []

    def frozen(node: list) -> int:
        """The state of a finished node; equal right languages share one."""
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(list(node[1]))
            accepts.append(node[0])
            sizes.append(node[0] + sum(sizes[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[False, []]]  # of the word before: accepting, finished arcs
    before = b""
    for word, _ in words:
        same = next((i for i, (x, y) in enumerate(zip(word, before, strict=False)) if x != y), min(len(word), len(before)))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], frozen(node)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        before = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((before[len(path) - 1], frozen(node)))
    root = frozen(path[0])
    flat = []
    for state, out in enumerate(arcs):
        skipped = int(accepts[state])
        for byte, target in sorted(out):
            flat.append((state, byte, target, skipped))
            skipped += sizes[target]
    table = np.array(flat, dtype=np.int32).reshape(-1, 4)
    starts = np.concatenate([[0], np.cumsum([len(ids) for _, ids in words])]).astype(np.int32)
    ids = np.array([i for _, x in words for i in x], dtype=np.int32)
    head = np.array([len(table), len(arcs), len(words), len(ids), root], dtype=np.int32)
    return b"".join(x.astype("<i4").tobytes() for x in (head, table.T.ravel(), np.array(accepts, dtype=np.int32), starts, ids))


class Lexicon:
    """Looks words up in a compiled transducer file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype="<i4", mode="r")
        arcs, states, words, ids, self.root = (int(x) for x in data[:5])
        at = 5
        table = data[at : at + 4 * arcs].reshape(4, arcs)
        at += 4 * arcs
        self.accepts = data[at : at + states]
        at += states
        self.starts = data[at : at + words + 1]
        self.ids = data[at + words + 1 : at + words + 1 + ids]
        self.key = table[0].astype(np.int64) << 8 | table[1]
        self.target, self.before = table[2], table[3]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, or -1: all words advance by one byte at a time."""
        raw = [w.encode() for w in words]
        length = np.array([len(r) for r in raw], dtype=np.int64)
        out = np.full(len(raw), -1, dtype=np.int64)
        if not len(self.key):
            return out
        text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        begin = np.cumsum(length) - length
        live = np.flatnonzero(length > 0)
        state = np.full(len(live), self.root, dtype=np.int64)
        number = np.zeros(len(live), dtype=np.int64)
        depth = 0
        while len(live):
            key = state << 8 | text[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key
            live, at = live[found], at[found]
            state, number = self.target[at].astype(np.int64), number[found] + self.before[at]
            depth += 1
            over = length[live] == depth
            done = over & (self.accepts[state] == 1)
            out[live[done]] = number[done]
            live, state, number = live[~over], state[~over], number[~over]
        return out

    def output(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


class Codec:
    """Encodes and decodes whole texts.

    Chunks (what stands between white space) and words met are kept, ``memo`` of each in the
    newer of two tables; when it is full it becomes the older one.
    """

    def __init__(self, bpe: WordBpe, lexicon: Lexicon, memo: int = 350_000):
        self.bpe, self.lexicon, self.memo = bpe, lexicon, memo
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.word: dict[str, tuple[str, str]] = {}
        self.older_word: dict[str, tuple[str, str]] = {}

    def entry(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join(map(self.bpe.token.__getitem__, ids))

    def learn_words(self, words: set[str]) -> None:
        """Enter words: by the lexicon, or by merges if it does not hold them."""
        if len(self.word) > self.memo:
            self.older_word, self.word = self.word, {}
        new = []
        for w in words - self.word.keys():
            got = self.older_word.get(w)
            if got is None:
                new.append(w)
            else:
                self.word[w] = got
        for w, n in zip(new, self.lexicon.numbers(new).tolist(), strict=True):
            self.word[w] = self.entry(self.lexicon.output(n) if n >= 0 else self.bpe.merged(w))

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > self.memo:
            self.older, self.known = self.known, {}
        new = []
        for c in chunks - self.known.keys():
            got = self.older.get(c)
            if got is None:
                new.append(c)
            else:
                self.known[c] = got
        split = {c: self.bpe.words(c) for c in new if not c.isalpha()}
        plain = [c for c in new if c not in split]
        self.learn_words({w for x in split.values() for w in x}.union(plain))
        word, known = self.word, self.known
        for c in plain:
            known[c] = word[c]
        for c, x in split.items():
            if len(x) == 1:
                known[c] = word[x[0]]
            elif len(x) == 2:
                a, b = word[x[0]], word[x[1]]
                known[c] = (f"{a[0]} {b[0]}", f"{a[1]} {b[1]}") if a[0] and b[0] else a if a[0] else b
            else:
                parts = [p for w in x if (p := word[w])[0]]
                known[c] = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, ids joined by spaces, decoded text."""
        parts = []
        for t in texts:
            own: list[list[str] | str] = []
            for piece in self.bpe.special_pattern.split(t) if t and "<" in t else [t or ""]:
                own.append(piece if piece in self.bpe.special else self.bpe.chunks(self.bpe.normal(piece)))
            parts.append(own)
        missing: set[str] = set()
        for own in parts:
            for x in own:
                if not isinstance(x, str):
                    missing.update(itertools.filterfalse(self.known.__contains__, x))
        if missing:
            self.learn(missing)
        known, older = self.known, self.older
        out = []
        for own in parts:
            got: list[tuple[str, str]] = []
            for x in own:
                if isinstance(x, str):
                    got.append((str(self.bpe.special[x]), x))
                else:
                    found = list(map(known.get, x))
                    if None in found:  # the table was renewed for this very batch
                        found = [older[c] if g is None else g for c, g in zip(x, found, strict=True)]
                    got += found
            ids = " ".join([g[0] for g in got])
            if "  " in ids or ids[:1] == " " or ids[-1:] == " ":  # chunks without ids
                got = [g for g in got if g[0]]
                ids = " ".join([g[0] for g in got])
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join([g[1] for g in got])))
        return out


@functools.lru_cache(1)
def worker_codec(source: str, path: str, memo: int) -> Codec:
    """One codec per worker process: what it has met stays known from task to task."""
    return Codec(WordBpe(source), Lexicon(path), memo)


def frequent_words(docs: DataFrame, source: str, text_col: str, size: int, partial: int) -> list[str]:
    """The ``size`` most frequent words of all texts, for the lexicon.

    Each task counts its words (chunks met once among 100,000 don't count) and passes on those it met ``partial`` times or more; so
    what is shuffled follows the number of tasks and the head of the distribution, and the
    driver gets ``size`` short words. Which words are in the lexicon never changes a result.
    """
    kept = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches):
        bpe, chunks = WordBpe(kept.value), Counter()
        words: Counter = Counter()

        def settle():
            for c, n in chunks.items():
                if n > 1:
                    for w in bpe.words(c):
                        if len(w) <= 40:
                            words[w] += n
            chunks.clear()
            if len(words) > 200_000:  # the tail goes; the head stays countable
                for w, n in list(words.items()):
                    if n < partial:
                        del words[w]

        for (texts,) in rows_of(batches, [text_col]):
            for t in texts:
                if t:
                    chunks.update(bpe.chunks(bpe.normal(t)))
            if len(chunks) > 100_000:
                settle()
        settle()
        top = [(w, n) for w, n in words.items() if n >= partial]
        for at in range(0, len(top), 10_000):
            w, n = zip(*top[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    counts = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in counts.orderBy(F.desc("n"), "word").limit(size).select("word").collect()]


def bpe_encode(docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = 30_000, partial: int = 8, texts_out: bool = True, memo: int = 350_000) -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens``, ``ids`` (decimal, joined by spaces) and ``decoded``, with their SHA-256 digests.

    ``source`` is the text of a ``tokenizers`` JSON file. ``texts_out=False`` leaves ``ids``
    and ``decoded`` out and keeps the digests. ``memo`` bounds what a worker remembers (about 0.5 KB each). A null text counts as empty: no ids, an empty
    decoded text. Special tokens written in a text become their ids. Null ids and repeated
    rows stay; other columns are not read.
    """
    spark = docs.sparkSession
    bpe = WordBpe(source)
    words = frequent_words(docs, source, text_col, lexicon_size, partial)
    kept = spark.sparkContext.broadcast((source, compile_lexicon({w: bpe.merged(w) for w in words})))

    def run(batches):
        text, data = kept.value
        codec = worker_codec(text, mapped_file(data, ".lexicon"), memo)
        for doc_ids, texts in rows_of(batches, [id_col, text_col], 128):
            got = codec.encode(texts)
            cols = [pa.array(doc_ids, pa.int64()), pa.array([g[0] for g in got], pa.int64())]
            cols += [pa.array([hashlib.sha256(g[k].encode()).hexdigest() for g in got]) for k in (1, 2)]
            cols += [pa.array([g[k] for g in got], pa.string()) for k in (1, 2) if texts_out]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts_out else [])])

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts_out
    return docs.select(id_col, text_col).mapInArrow(run, schema)

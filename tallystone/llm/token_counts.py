"""Token counts by byte-pair merging over a heap and a linked list, with no identifiers emitted.

A text is a chain of symbols. A heap holds the adjacent pairs whose union is a piece of
the vocabulary, lowest rank first and leftmost among equals; each pop merges one pair and
offers its two new neighbours. The count is the number of initial symbols less the merges,
plus the additional bytes of symbols that no piece covers.
"""

from __future__ import annotations

import functools
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_of

#: The sign that stands for a space in the pieces (fixed by the model format).
SPACE = "▁"


class PieceCounter:
    """Counts the tokens of texts for a byte-pair model with byte fallback and no text normalisation.

    ``model`` is the serialised model file. Counts of segments (a run of spaces and what
    follows up to the next) are kept in two tables of at most ``memo`` entries each, the
    older of which is dropped when the newer is full; no piece goes on
    after a space or a line end, so segments never merge with each other.
    """

    def __init__(self, model: bytes, memo: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.normalize(" ﬁ  a ") != SPACE * 2 + "ﬁ" + SPACE * 2 + "a" + SPACE:
            raise ValueError("the model normalises its input or adds no prefix; only identity models are supported")
        pieces = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in pieces}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("pieces that go on after a space or a line end are not supported")
        self.memo = memo
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """The number of tokens of one segment."""
        rank = self.rank
        sym: list[str | None] = list(text)
        n = len(sym)
        count = n
        if n > 1:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(sym[i] + sym[i + 1])) is not None]
            heapq.heapify(heap)
            while heap:
                _, i, size = heapq.heappop(heap)
                a = sym[i]
                if a is None or (j := right[i]) >= n:
                    continue
                b = sym[j]
                if len(a) + len(b) != size:  # one of the two has grown meanwhile
                    continue
                sym[i], sym[j] = a + b, None
                count -= 1
                k = right[i] = right[j]
                a = sym[i]
                if k < n:
                    left[k] = i
                    if (r := rank.get(a + sym[k])) is not None:
                        heapq.heappush(heap, (r, i, size + len(sym[k])))
                if (h := left[i]) >= 0 and (r := rank.get(sym[h] + a)) is not None:
                    heapq.heappush(heap, (r, h, len(sym[h]) + size))
        for s in sym:  # a symbol that is no piece is one character, given as bytes
            if s is not None and s not in rank:
                count += len(s.encode("utf-8", "surrogatepass")) - 1
        return count

    def segment(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            if len(self.known) >= self.memo:
                self.older = dict(self.known)
                self.known.clear()
            n = self.older.get(text)
            if n is None:
                n = self.merged(text)
            if len(text) < 64:
                self.known[text] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; none for an empty one."""
        if not text:
            return 0
        lines = (" " + text.replace(SPACE, " ")).split("\n")
        total = len(lines) - 1
        known, segment = self.known, self.segment
        for line in lines:
            words = line.split(" ")
            if words[0]:
                total += segment(words[0])
            spaces = ""
            for w in words[1:]:
                if w:
                    w = f"{spaces}{SPACE}{w}"
                    n = known.get(w)
                    total += segment(w) if n is None else n
                    spaces = ""
                else:
                    spaces += SPACE
            if spaces:
                total += segment(spaces)
        return total


@functools.lru_cache(1)
def worker_counter(model: bytes) -> PieceCounter:
    """One counter per worker process: the segments that it has met stay known from task to task."""
    return PieceCounter(model)


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    One narrow Python pass and no shuffle; the model travels as a broadcast of fixed size.
    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows stay as
    they are; other columns are not read.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)
    field = docs.schema[id_col]

    def run(batches):
        counter = worker_counter(kept.value)
        for ids, texts in rows_of(batches, [id_col, text_col]):
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(field.name, text_col).mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")

"""Every operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallystone.llm import ann, bpe_codec, common, html_extract, jaccard_join, line_quality, lm_score, mixing, secrets, substring_dedup, token_counts
from tallystone.llm.queries import read_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, source string, k long, id string, row int, spans string, t int, n int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, "y", 3, 4, "z") for i, t, s in rows], SCHEMA)


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    a, b = " ".join(words(120, 1)), " ".join(words(90, 2))
    near = a.replace("w", "w", 1).split()
    near[5] = "changed"
    return [
        (1, a, "s1"), (2, " ".join(near), "s1"), (3, a, "s2"), (3, a, "s2"), (4, None, None), (5, "", "s1"), (None, b, "s3"), (7, "one two", None), (8, "one  TWO\n", "s2"),
        (9, b + " tail", "s3"), (10, "x" * 60_000, "s1"), (11, "\x00 ﬁ É \U0001d4b3 \x1c\x85", "s1"), (12, " ".join(words(9000, 3, 9000)), "s2"),
    ]


# --- 1 ----------------------------------------------------------------------------------------


def passage(seed):
    r = random.Random(seed)
    return " ".join(" ".join(f"p{r.randrange(10**6)}" for _ in range(14)).capitalize() + "." for _ in range(5))


def own(seed):
    r = random.Random(seed)
    return " ".join(" ".join(f"o{r.randrange(10**6)}" for _ in range(11)).capitalize() + "." for _ in range(6))


def test_repeated_passages_go_from_all_but_the_first(spark):
    p = passage(1)
    texts = {1: own(11) + " " + p + " " + own(12), 2: own(21) + "\n" + p + " " + own(22), 3: own(31), 4: None, 5: ""}
    rows = [*texts.items(), (2, texts[2])]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got[1].text == texts[1] and got[3].text == texts[3] and got[4].text is None and got[5].text == ""
    assert p.split(". ")[2] not in got[2].text and own(21) in got[2].text and own(22) in got[2].text
    assert got[2].n_removed == 5 and got[4].n_sentences == 0


def test_spans_by_brute_force(spark):
    r = random.Random(5)
    pool = [" ".join(f"q{r.randrange(500)}" for _ in range(r.choice([3, 9, 26]))) + "." for _ in range(30)]
    docs = [(i, " ".join(r.choice(pool) for _ in range(12)), "s") for i in range(25)]
    first: dict = {}
    expected = {}
    for i, text, _ in docs:
        parts = [s for s in substring_dedup.sentences(text)]
        gone = set()
        for at in range(len(parts)):
            runs = [(at, at + 1)] if len(parts[at].split()) >= 25 else []
            end = next((e for e in range(at + 2, len(parts) + 1) if len(" ".join(parts[at:e]).split()) >= 20), None)
            runs += [(at, end)] if end else []
            for a, b in runs:
                span = tuple(" ".join(parts[a:b]).split())
                if first.setdefault(span, (i, a)) != (i, a):
                    gone |= set(range(a, b))
        expected[i] = len(gone)
    got = {x.doc_id: x.n_removed for x in substring_dedup.dedup(frame(spark, docs)).collect()}
    assert got == expected and any(expected.values())


def test_tails_and_short_texts_of_copies_go(spark):
    tail = own(41) + " The end."
    passage_ = passage(3) + " So it goes."
    docs = [(1, tail, "s"), (2, tail, "s"), (3, "Only a few words.", "s"), (4, "only a  few words.", "s"), (5, "Other words.", "s"), (6, own(51) + " " + passage_ + " " + own(52), "s"), (7, own(61) + "\n" + passage_ + " " + own(62), "s")]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, docs)).collect()}
    assert got[1].text == tail and got[2].text == "" and got[2].n_removed == got[2].n_sentences == 7
    assert got[3].text == "Only a few words." and got[4].text == "" and got[5].text == "Other words."
    assert got[6].text == docs[5][1] and got[7].text.split() == (own(61) + " " + own(62)).split()


# --- 2 ----------------------------------------------------------------------------------------


def test_language_model_is_normalised_and_beats_unigrams_on_held_out_texts(spark):
    r = random.Random(2)
    tongues = [[f"{c}{i}" for i in range(60)] for c in ("a", "b", "c")]
    docs = [(i, " ".join(r.choices(tongues[i % 3], k=60)), "s") for i in range(700)] + [(None, None, "s"), (900, "", "s"), (901, "unmet words here", "s")]
    got = lm_score.lm_scores(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    toks = {i: (t.lower().split() if t else []) + [None] for i, t, _ in docs}
    c = Counter(w for i, x in toks.items() if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for x in got:
        own_ = toks[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own_), sum(c[w] > 0 for w in own_), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own_), rel_tol=1e-9)
    held = [x for x in got if x.held_out and x.n_tokens > 10]
    assert len(held) > 50 and sum(x.score for x in held) > sum(x.base_score for x in held)


def test_probabilities_of_both_levels_sum_to_one():
    counts = [50] + sorted((5 + 3000 // (i + 1) for i in range(420)), reverse=True)
    words_ = [b""] + [f"w{i}".encode() for i in range(420)]
    tails: dict = {}
    for w, c in [*zip(words_, counts, strict=True), *((f"rare{i}".encode(), 1) for i in range(900))]:
        k = zlib.crc32(w[-3:]) % lm_score.TAILS
        tails[k] = (tails.get(k, (0, 0))[0] + c, tails.get(k, (0, 0))[1] + 1)
    v = lm_score.Vocabulary(words_, counts, sum(counts) + 900, 1321, tails)
    model = lm_score.LogBilinear.begin(v, 3)
    assert lm_score.TOP < v.own and v.group.max() == v.groups - 1
    for p1, p2 in ((0, 1), (v.start, v.start), (v.own + 5, 7)):
        units = np.arange(v.own + lm_score.TAILS)
        p = np.exp(model.log_probs(units, np.full(len(units), p1), np.full(len(units), p2)))
        assert math.isclose(p.sum(), 1, rel_tol=1e-4)
    steps = model.train(1, 0.1)
    next(steps)
    before = model.log_probs(np.array([300]), np.array([5]), np.array([6]))
    for _ in range(30):
        steps.send((np.full(64, 300), np.full(64, 5), np.full(64, 6)))
    assert model.log_probs(np.array([300]), np.array([5]), np.array([6])) > before + 1


def test_the_model_does_not_follow_partitions(spark):
    r = random.Random(6)
    docs = [(i, " ".join(f"{'abc'[i % 3]}{min(int(r.expovariate(0.02)), 900)}" for _ in range(60)), "s") for i in range(400)]
    runs = [{x.doc_id: x.score for x in lm_score.lm_scores(frame(spark, docs).repartition(n)).collect()} for n in (1, 8, 64)]
    assert all(math.isclose(run[i], runs[0][i], rel_tol=1e-4) for run in runs for i in runs[0])


def test_vocabulary_grows_and_packs_of_many_ranges_lose_nothing(spark, monkeypatch):
    sizes = [lm_score.own_tokens(n) for n in (10**5, 10**6, 10**7, 10**9)]
    assert sizes == sorted(set(sizes)) and lm_score.own_tokens(10**15) == lm_score.FREQUENT
    docs = [(i, " ".join(words(50, i, 3000)) + " " + "é" * 90, "s") for i in range(60)]
    want = {x.doc_id: (x.n_known, x.base_score, x.score) for x in lm_score.lm_scores(frame(spark, docs)).collect()}
    monkeypatch.setattr(lm_score, "FREQUENT", 300)
    monkeypatch.setattr(lm_score, "FAN", 3)
    monkeypatch.setattr(lm_score, "SORT", 40)
    got = {x.doc_id: (x.n_known, x.base_score, x.score) for x in lm_score.lm_scores(frame(spark, docs)).collect()}
    assert all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], rel_tol=1e-9) and math.isfinite(got[i][2]) for i in want)


def test_tokens_of_any_text_by_brute_force(spark):
    r = random.Random(8)
    signs = [*map(chr, range(1, 128)), "é", "\x85", "\u2003", "Ä", "\U0001d4b3", *" \n" * 20]
    texts = [None, "", " ", "é" * 40, "é" * 40 + " in a text longer than the bytes of a digest, and some more", "x" * 64 + " " + "X" * 65, *("".join(r.choices(signs, k=r.randrange(200))) for _ in range(120))]
    docs = list(enumerate(texts)) + [(i, None) for i in range(200, 207)]
    got = {x.doc_id: x for x in lm_score.lm_scores(frame(spark, [(i, t, "s") for i, t in docs])).collect()}
    toks = {i: [*WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}) if t else ""), None] for i, t in docs}
    c = Counter(w for i, x in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for i, own_ in toks.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own_), sum(c[w] > 0 for w in own_), n), texts[i]
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own_), rel_tol=1e-9), texts[i]


def test_normalisers_take_exponentials_for_contexts_not_for_pairs(monkeypatch):
    counts = [50] + sorted((5 + 3000 // (i + 1) for i in range(420)), reverse=True)
    words_ = [b""] + [f"w{i}".encode() for i in range(420)]
    tails: dict = {}
    for w, c in zip(words_, counts, strict=True):
        k = zlib.crc32(w[-3:]) % lm_score.TAILS
        tails[k] = (tails.get(k, (0, 0))[0] + c, tails.get(k, (0, 0))[1] + 1)
    v = lm_score.Vocabulary(words_, counts, sum(counts), 421, tails)
    model = lm_score.LogBilinear.begin(v, 3)
    p1, p2 = (x.ravel() for x in np.meshgrid(np.arange(150), np.arange(100, 250)))
    taken = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, x, **how):
            taken.append(x.size)
            return np.exp(x, **how)

    def want():
        x, c, t = (a.astype(np.float64) for a in (model.x, model.c, model.t))
        scores = (x[p1] @ c[: lm_score.DIM] + x[p2] @ c[lm_score.DIM :]) @ t[:, :-1].T + t[:, -1]
        top = scores.max(axis=1)
        return scores[:, 0] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))

    monkeypatch.setattr(lm_score, "np", Counting())
    assert np.allclose(model.log_probs(np.zeros(len(p1), dtype=np.int64), p1, p2), want(), atol=1e-4)
    assert sum(taken) <= 2 * 150 * v.groups
    monkeypatch.setattr(lm_score, "BLOCK", 100)
    monkeypatch.setattr(lm_score, "WINDOW", 7000)
    model.x[[3, 120]] *= 300  # factors beyond what single precision holds
    model.t[:, -1] -= 200
    got = model.log_probs(np.zeros(len(p1), dtype=np.int64), p1, p2)
    assert np.isfinite(got).all() and np.allclose(got, want(), rtol=1e-4, atol=1e-3)


# --- 3 ----------------------------------------------------------------------------------------


def test_nearest_by_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    vectors = {i: (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist() for i in range(1, 900)}
    vectors[101] = vectors[100]
    vectors[102] = [2 * x for x in vectors[100]]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (None, vectors[1]), (2005, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in [*vectors.items(), *bad]], "vec_id long, embedding array<double>, f int, v double")
    got: dict = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array(list(vectors))
    m = np.array([vectors[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in (i for i in vectors if i % 50 == 0):
        s = m @ m[ids == q][0]
        best = [i for i in sorted(ids, key=lambda i: (-round(float(s[ids == i][0]), 12), i)) if i != q][:5]
        assert len(got[q]) == 5 and all(math.isclose(x, float(s[ids == i][0]), abs_tol=1e-9) for i, x in got[q])
        hits, total = hits + len({i for i, _ in got[q]} & set(best)), total + 5
    assert hits / total >= 0.9 and got[100][0][0] == 101
    assert ann.search(df.where("vec_id = 50")).collect() == []
    small = [(1, [1.0, 0.0]), (50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 3.1]), (52, [3.0, 0.0, 0.0]), (100, [0.0, 1.0]), (150, [1.0] * 5), (200, [])]
    few = ann.search(spark.createDataFrame(small, "vec_id long, embedding array<double>"), block=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(50, 1, 51), (50, 2, 52), (100, 1, 1)]
    assert ann.search(df.limit(0)).collect() == []


# --- 4 ----------------------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    inside = {j for i, x in enumerate(win) if c[x] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(inside)


def test_line_rules(spark, rows):
    common = "the same line of many pages here today"
    filler = lambda i: "\n".join(" ".join(f"u{i}x{j}y{k}" for k in range(8)) for j in range(3))
    docs = [*rows, *[(100 + i, f"{common}\n{filler(i)}", "host") for i in range(30)], *[(200 + i, f"{common}\nshort tail{i}", "host") for i in range(5)], (300, "a b c d e f " * 40, "host"), (301, "x\nx\n\ty # | x\n", "host")]
    got = line_quality.quality(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    by = {}
    for i, t, _ in docs:
        by.setdefault(i, []).append(brute_counts(t))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in by[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[100 + i] for i in range(30)) and not any(kept[200 + i] for i in range(5)) and not kept[300]
    clash = frame(spark, docs).withColumn("gone", F.lit(1)).withColumn("own", F.lit("x"))
    assert line_quality.passing(clash).columns == clash.columns
    passing = line_quality.passing(frame(spark, docs))
    assert passing.columns == frame(spark, docs).columns and passing.count() == sum(r.kept for r in got)


def test_frequent_lines_leave_the_texts(spark):
    common = "the same  Line of many pages"
    body = lambda i: "\n\n".join(" ".join(f"v{i}x{j}y{k}" for k in range(8)) for j in range(3))
    docs = [(i, f"{common}\n{body(i)}", "host") for i in range(25)] + [(5, f"{common}\n{body(5)}", "host"), (99, f"{common}\n{body(99)}", "other")]
    got = line_quality.passing(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t if i in (0, 99) else body(i)) for i, t, _ in docs)


# --- 5 ----------------------------------------------------------------------------------------

BASE = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def brute_spans(t):
    return sorted((m.start(), k, n, m.end()) for k, (n, p, g, least) in enumerate(BASE) for m in p.finditer(t or "") if len(m[g]) >= least)


def test_secrets(spark, rows):
    r = random.Random(9)
    odd = ["token", "=", '"', " ", "secret: ", "abcdef0123456789", "AKIA", "ABCDEFGH01234567", "é", "\U0001d4b3", "PassWord=", "'", "x", "\n", "api_key", "apikey:"]
    key = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=40)) + "7aQ"
    docs = [*rows, (50, f"é use {key} now", "s"), (51, "an_ordinary_identifier_name1 and understandable2", "s"), *[(60 + i, "".join(r.choices(odd, k=14)), "s") for i in range(120)]]
    df = frame(spark, docs)
    found = secrets.find_secrets(df)
    assert found.count() == len(docs)
    texts = {}
    for i, t, _ in docs:
        texts.setdefault(i, []).append(t)
    for x in found.collect():
        base = [(s.start, s.kind, s.end) for s in x.spans if s.kind != "markov"]
        assert base in [[(a, n, e) for a, _, n, e in brute_spans(t)] for t in texts[x.doc_id]]
        assert [s.start for s in x.spans] == sorted(s.start for s in x.spans)
    one = {x.doc_id: x.spans for x in found.where("doc_id in (50, 51)").collect()}
    assert [(s.kind, s.value) for s in one[50]] == [("markov", key)] and one[51] == []
    clean = secrets.redact(df)
    assert clean.columns == df.columns and clean.where("doc_id = 50").first().text == "é use <|secret|> now"


def test_secrets_of_held_out_strings(spark):
    import builtins
    import keyword

    r = random.Random(77)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    drawn = ["".join(r.choices(a, k=r.randrange(18, 48))) for a in (b64, b64, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(200)]
    late = ["".join(r.choices(b64[:52], k=a)) + "7" + "".join(r.choices(b64[:52], k=62 - a)) for a in (30, 42) for _ in range(40)]
    parts = [w.lower() for w in (*keyword.kwlist, *dir(builtins)) if w.isalpha() and len(w) > 2]
    plain = ["".join(f(w) for w in r.sample(parts, 4)) if sep == "" else sep.join(r.sample(parts, 4)) for sep, f in (("", str.capitalize), ("_", str), ("/", str), ("-", str)) for _ in range(150)]
    plain = [p for p in plain if len(p) >= 16]
    docs = [(i, f"is {w} here", "s") for i, w in enumerate([*drawn, *late, *plain])]
    hit = {x.doc_id for x in secrets.find_secrets(frame(spark, docs)).where("size(spans) > 0").collect()}
    n = len(drawn) + len(late)
    recall, wrong = len([i for i in hit if i < n]) / n, len([i for i in hit if i >= n])
    assert recall >= 0.95 and wrong <= 0.02 * len(plain), (recall, wrong, len(plain))


def test_secrets_after_a_sign_of_assignment_and_without_digits(spark):
    r = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    drawn = lambda n, size: "".join(r.choices(alphabet[:n], k=size))
    docs = [(i, f"{name}={drawn(n, 24)} rest", "s") for i, (name, n) in enumerate([(name, n) for name in ("AUTH", "export AWS_KEY", "https://x.example/?sig") for n in (52, 64)] * 20)]
    plain = ["0" * 20, "4111111111111111", "2024-01-02-2024-03-04", "/" * 30, "+" * 30, "-" * 30, "/usr/local/lib/python/site-packages", "internationalization", "MAX_CONNECTION_RETRY_COUNT", "a" * 20]
    docs += [(1000 + i, f"name={p} {p}", "s") for i, p in enumerate(plain)]
    found = {x.doc_id: [(s.kind, s.value) for s in x.spans] for x in secrets.find_secrets(frame(spark, docs)).collect()}
    hits = sum(found[i] == [("markov", t.split("=", 1)[1].split()[0])] for i, t, _ in docs if i < 1000)
    assert hits >= 0.95 * 120, hits
    assert [p for i, p in enumerate(plain) if found[1000 + i]] == []


# --- 6 and 10 ---------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(frame(spark, rows), read_file("piece_bpe_32k.model", True), limit=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t, _ in rows)
    counter = token_counts.PieceCounter(read_file("piece_bpe_32k.model", True), memo=50)
    r = random.Random(3)
    for _ in range(3000):
        x = "".join(r.choices(["a", "the", " ", "  ", "\n", "▁", "é", "ｱ", "\x00", "<s>", "ing", "<0x0A>", "😀"], k=r.randrange(12)))
        assert counter.count(x) == len(sp.encode(x))


def test_encoding_equals_the_library(spark, rows):
    from tokenizers import Tokenizer

    source = read_file("word_bpe_49k.json")
    tk = Tokenizer.from_str(source)
    docs = [*rows, (20, "It's <|endoftext|>THE end<|startoftext|>", "s"), (21, "don't 12³ ΑΣ É\x1cx", "s")]
    got = bpe_codec.bpe_encode(frame(spark, docs), source, partial=1).collect()
    want = Counter()
    for i, t, _ in docs:
        e = tk.encode(t or "", add_special_tokens=False)
        want[i, len(e.ids), " ".join(map(str, e.ids)), tk.decode(e.ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got) == want
    assert all(hashlib.sha256(r.ids.encode()).hexdigest() == r.ids_sha256 for r in got)


def test_lexicon_is_minimal_and_exact(tmp_path):
    r = random.Random(1)
    entries = {"".join(r.choices("abc", k=r.randrange(1, 7))): [r.randrange(100) for _ in range(r.randrange(1, 4))] for _ in range(300)}
    (tmp_path / "x").write_bytes(bpe_codec.compile_lexicon(entries))
    lex = bpe_codec.Lexicon(str(tmp_path / "x"))
    names = [*entries, "", "d", "abcabcabc"]
    got = [lex.output(n) if n >= 0 else None for n in lex.numbers(names).tolist()]
    assert got == [entries.get(n) for n in names]
    states = len(lex.accepts)
    rights = {tuple(sorted(w[len(p) :] for w in entries if w.startswith(p))) for w in entries for p in [w[:i] for i in range(len(w) + 1)]}
    assert states == len(rights)


# --- 7 ----------------------------------------------------------------------------------------


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    items = list(dict.fromkeys((i, t) for i, t, _ in docs))
    sets = [shingle_set(t) for _, t in items]
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    out = {}
    for i, x in enumerate(items):
        ids = [items[j][0] for j in range(len(items)) if find(j) == find(i) and items[j][0] is not None]
        out[x] = (len(sets[i]), min(ids) if ids else None)
    return items, out


def test_components_by_brute_force(spark, rows):
    r = random.Random(7)
    docs = list(rows)
    for g in range(12):
        base = words(r.choice([12, 60, 200, 1500]), 100 + g, 50_000)
        for c in range(10):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, len(w) // 40, len(w) // 30, len(w) // 20])):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            docs.append((1000 + 20 * g + c, " ".join(w), "s"))
    items, want = brute_components(docs)
    got = jaccard_join.jaccard_components(frame(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, *want[i, t]) for i, t, _ in docs)
    kept = jaccard_join.representatives(frame(spark, docs))
    n_components = len({want[x][1] for x in items if want[x][0]})
    assert kept.where("length(trim(text)) > 0").count() == n_components and kept.columns == frame(spark, docs).columns


def test_rarity_counts_the_shingles_of_all_documents(spark):
    texts = [" ".join(f"w{i * j % 7}x{j}" for j in range(40)) for i in range(30)] + ["a b c d e f"] * 20 + [None, "", "one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    shingle, want = jaccard_join.Shingler(5), np.zeros(1 << 16, dtype=np.int64)
    for t in texts:
        np.add.at(want, (shingle(t) >> np.uint64(48)).astype(np.int64), 1)
    for parts in (1, 7):
        assert jaccard_join.rarity(docs.repartition(parts), "text", 5).tolist() == [int(c).bit_length() for c in want]
    assert not jaccard_join.rarity(docs.limit(0), "text", 5).any()



def test_tree_bounds_never_lose_a_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, size=rng.integers(5, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(80)]
    sets += [np.delete(s, 0) for s in sets if len(s) > 10]
    points = np.array([jaccard_join.folded(jaccard_join.point(s)) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard_join.CountTree(points, sizes, 80)
    for i, s in enumerate(sets):
        linked = {j for j, o in enumerate(sets) if jaccard_join.linked(s, o, 80)}
        assert linked <= set(tree.search(points[i], len(s)).tolist())


# --- 8 ----------------------------------------------------------------------------------------


def test_mixture_meets_capped_targets(spark, rows):
    r = random.Random(8)
    docs = [*rows, *[(5000 + i, " ".join(["w"] * r.randrange(1, 60)), r.choice(["s1", "s2", "s3", "é", "zz"])) for i in range(400)], *[(9000 + i, "tiny", "aa") for i in range(3)], (9100, None, "none")]
    df = frame(spark, docs)
    got = mixing.mix(df).collect()
    assert len(got) == len(docs)
    size = lambda t: len((t or "").encode().split())
    names = sorted({s for _, _, s in docs if s is not None}, key=lambda s: s.encode()) + [None]
    total = {s: sum(size(t) for _, t, x in docs if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    source = {}
    for i, t, s in docs:
        source.setdefault((i, size(t)), s)
    taken = Counter()
    for x in got:
        s = source[x.doc_id, x.size]
        assert x.source_size == total[s] and math.isclose(x.target, target[s], rel_tol=1e-9) and 0 <= x.taken <= 3 * x.size
        taken[s] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))


def test_repeated_rows_keep_their_own_columns(spark):
    docs = [(1, "a b c", "s", "p"), (1, "a b c", "s", "q"), (2, "d e", "s", "p"), (2, "d e", "s", "p"), (3, None, None, "x"), (None, "f", "t", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, key string").withColumn("__n", F.lit(1)).withColumn("__key", F.lit(2))
    got = Counter((r.doc_id, r.key) for r in mixing.repeated(df).collect())
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id] += (2 * r.taken + r.size) // (2 * r.size) if r.size else 0
    assert mixing.repeated(df).columns == df.columns and got[1, "p"] > 0 and got[1, "q"] > 0
    assert {i: sum(n for (j, _), n in got.items() if j == i) for i in (1, 2, 3, None)} == {i: taken[i] for i in (1, 2, 3, None)}
    assert mixing.repeated(df.limit(0)).count() == 0


# --- shared helpers ---


def test_salted_join_equals_the_plain_one(spark):
    left = spark.range(20_000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("h"), F.col("id").alias("x"))
    right = left.groupBy("h").agg(F.count("*").alias("n"), F.min("x").alias("first")).where("n > 1")
    out = common.spread_join(left, right, ["h"], "n", F.col("x"))
    assert out.count() == left.join(right, "h").count() == right.agg(F.sum("n")).first()[0]
    assert set(out.columns) == {"h", "a", "x", "first"} and out.where("first <> 0").count() == 0


def test_shared_folder_and_staged_tables(spark, monkeypatch):
    since = len(common.MADE)
    a, b = common.staged(spark.range(3), "a"), common.staged(spark.range(4), "b")
    common.drop_staged(spark, since, keep=b)
    assert b.count() == 4 and len(common.MADE) == since + 1
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|FAILED_READ"):
        a.collect()
    assert common.fresh(["key", "N_"], "key", "n", "n_") == ["key_", "n", "n__"]

    class Away:
        conf, sparkContext = type("C", (), {"get": lambda *_: None}), type("S", (), {"master": "yarn", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Away)


# --- 9 ----------------------------------------------------------------------------------------


def test_main_text(spark):
    page = lambda i, body: (i, f"https://h.example/{i}", f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home{i}</a></ul></nav>{body}<footer>&copy; x{i}</footer></body></html>")
    pages = [
        page(1, "<div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br><p>three<aside>side</aside><p>four &#233;</article><div id=comments><p>nice</div>"),
        page(2, "<main><header><h1>Title</h1></header><section><p>body <i>text</i></p></section><form>name<input></form></main><div class='cookie-notice'>ok?</div>"),
        (3, None, None), (4, "x", ""), (5, "https://h.example/5", "plain text only &lt; <unclosed"), (1, None, "<p>again"),
    ]
    pages += [(10 + i, f"https://s.example/{i}", f"<body><div class=top>Welcome to our site</div><div class=story><p>Story {i} begins</p><p>and {i * 7} ends</p></div></body>") for i in range(20)]
    df = spark.createDataFrame([(*p, 1, "q") for p in pages], "page_id long, url string, html string, host int, low string")
    got = {(r.page_id, r.url): r for r in html_extract.extract(df).collect()}
    assert got[1, "https://h.example/1"].text == "A & B\none two\nthree\nfour é"
    assert got[2, "https://h.example/2"].text == "Title\nbody text"
    assert got[3, None].text == "" and got[4, "x"].text == "" and got[1, None].text == "again"
    assert got[5, "https://h.example/5"].text.startswith("plain text only <")
    assert got[15, "https://s.example/5"].text == "Story 5 begins\nand 35 ends"
    assert all(r.n_chars == len(r.text) for r in got.values())


def brute_importances(pages, gamma=0.9, prior=8.0):
    """Importance of each (host, path hash) with text, by plain counting."""
    facts = {}
    for host, source in pages:
        page = html_extract.Page(source)
        facts[host, tuple(page.blocks)] = html_extract.features(page, host)
    k, kk, x, shapes, texts = Counter(), Counter(), {}, {}, {}
    for (host, _), own_ in facts.items():
        for path, feature, weight, extra in own_:
            k[host, path, feature, weight] += 1
            kk[path, feature, weight] += 1
            if weight == 0:
                x[host, path] = (extra, feature)
            elif weight < 0:
                shapes.setdefault((host, path), Counter())[feature] += 1
            else:
                texts.setdefault((host, path), set()).add((feature, weight))
    out = {}
    for (host, path), own_ in texts.items():
        p, up = x[host, path]
        m, mm = k[host, path, up, 0], kk[path, up, 0]
        w = sum(g * k[host, path, f, g] for f, g in own_)
        one = 1 - sum(g * k[host, path, f, g] * math.log(k[host, path, f, g]) for f, g in own_) / w / math.log(m) if m > 1 else 1
        two = 1 - sum(g * k[host, path, f, g] * math.log(kk[path, f, g]) for f, g in own_) / w / math.log(mm) if mm > 1 else 1
        seen = shapes[host, up]
        n = sum(seen.values())
        shown = -sum(c / n * math.log(c / n, n) for c in seen.values()) if n > 1 else 1
        e = math.log2(mm)
        out[host, path] = (e * (gamma * max(0, min(one, two)) + (1 - gamma) * shown) + prior * p) / (e + prior)
    return out


def test_importances_by_brute_force_and_what_they_remove(spark):
    r = random.Random(4)
    some = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    ads = [some(6) for _ in range(4)]
    pages = []
    for h in range(5):
        for i in range([2, 30, 40, 50, 60][h]):
            lead = f"<section class=q{h}><p>All about site {h}</p></section>"
            body = "".join(f"<p>{some(20)}</p>" for _ in range(r.randrange(1, 5)))
            pages.append((f"h{h}.example", f"<body>{lead}<div class=x1>{r.choice(ads)}</div><div class=y{i}><h2>{some(4)}</h2>{body}</div><div class=z>h{h}.example {r.choice(ads)}</div></body>"))
    pages += pages[:3]
    df = spark.createDataFrame([(i, f"https://{h}/{i}", t, h) for i, (h, t) in enumerate(pages)], "page_id long, url string, html string, host string")
    want = brute_importances(pages)
    got = {(x.host, y.path): y.importance for x in html_extract.importances(df, 2.0, 0.9, 8.0).collect() for y in x.low}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-6) for x in want)
    for x in html_extract.extract(df).collect():
        host, source = pages[x.page_id]
        page = html_extract.Page(source)
        left = [(p, t) for p, t in page.blocks if want[host, p] >= 0.5]
        assert x.text == "\n".join(t for _, t in left)
    texts = "\n".join(x.text for x in html_extract.extract(df).collect())
    assert not any(a in texts for a in ads)


def test_no_name_voids_an_article(spark):
    story = "<h1>Headline</h1><p>A story of some words.</p><p>And more of it.</p>"
    whole = "Headline\nA story of some words.\nAnd more of it."
    wraps = [
        "<div class='content has-sidebar'>{}</div>", "<div class='site social-science'>{}</div>", "<article class='post comment-open'>{}</article>", "<article id='related-work'>{}</article>",
        "<form id='aspnetForm'><div>{}</div></form>", "<body class='layout has-sidebar'>{}</body>", "<div class='page no-sidebar with-footer'>{}</div>", "<div class='post widget-area'><div class='content-header'>{}</div></div>",
        "<div class='sidebar right'><article>{}</article></div>", "<main><div class=article-header>{}</div></main>",
    ]
    pages = [(i, f"https://w{i}.example/", w.format(story)) for i, w in enumerate(wraps)]
    pages += [(50, "https://t.example/", "<h1>Title</h1><article><p>A</p></article><div class='story'>second part</div>"), (51, "https://u.example/", "<nav><a>x</a></nav><footer>y</footer><form>z<input></form>"), (52, None, "<article><p>a<section class='reader-comments'><p>me too</section></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert [got[i] for i in range(len(wraps))] == [whole] * len(wraps)
    assert got[50] == "Title\nA\nsecond part" and got[51] == "" and got[52] == "a"


def test_an_article_of_many_copies_stays(spark):
    pages = [(i, f"https://c{i}.example/", f"<nav>Home</nav><div class=box><p>{'the same article ' * 30}</p></div><footer>All rights {i % 5}</footer>") for i in range(300)]
    pages += [(1000 + i, f"https://d{i}.example/", f"<nav>Home</nav><div class=box><p>{'own article ' * 20} {i}</p></div><footer>All rights</footer>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert all(got[i].startswith("the same article") and "\n" not in got[i] for i in range(300)) and all(got[1000 + i].startswith("own") for i in range(30))


# --- all --------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert substring_dedup.dedup(none).count() == 0
    assert line_quality.quality(none).count() == 0
    assert secrets.find_secrets(none).count() == 0
    assert token_counts.token_counts(none, read_file("piece_bpe_32k.model", True)).count() == 0
    assert bpe_codec.bpe_encode(none, read_file("word_bpe_49k.json")).count() == 0
    assert mixing.mix(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert lm_score.lm_scores(none).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

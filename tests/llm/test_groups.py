"""Hard negatives, spelling variants and line deduplication against brute force, with edge rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bathyspark.llm import hard_negatives as hn
from bathyspark.llm import lines, spelling


# ------------------------------------------------------------------ 11
def brute_negatives(rows):
    held = {}
    for vec, v, label in rows:
        if None in (vec, v, label) or not v or not all(x is not None and np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(256 * float(x))) for x in v]
        if max(map(abs, ints)) > 2**20:
            continue
        held[vec] = min(held.get(vec, (99, (), ())), (label, len(ints), tuple(ints)))
    out = set()
    for a, (label, dim, v) in held.items():
        if a % 5:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, n, w) in held.items() if i != a and n == dim}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if held[i][0] == label][:5]:
            fits = [i for i in order if held[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(fits[:3], 1)}
    return out


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 70)
    monkeypatch.setattr(hn, "ANCHORS", 30)
    monkeypatch.setattr(hn, "AT_ONCE", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=19).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(i, (rng.normal(size=3) * 400).tolist(), i % 2) for i in range(300, 340)]  # another length, wide integers
    rows += [(i, [0.5, 0.25], i % 2) for i in range(340, 380)]  # ties
    rows += [(400, [0.0] * 19, 1), (405, None, 1), (410, [1.0] * 19, None), (None, [1.0] * 19, 1), (415, [float("nan")] * 19, 0), (420, [1.0, None], 0),
             (425, [], 0), (430, [1e300] * 19, 1), (435, [float("inf")] * 19, 1), rows[5], (10, [0.1] * 19, 0), (440, [1.0] * 7, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"ids": F.lit(1), "block": F.lit(2), "score": F.lit(3)})
    got = [tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == brute_negatives(rows)
    assert hn.hard_negatives(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    assert hn.hard_negatives(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("top", [1, 200, 2**15])
def test_scores_are_exact(top):
    rng = np.random.default_rng(top)
    a, c = rng.integers(-top, top, (5, 21)), rng.integers(-top, top, (40, 21))
    assert (hn.scores(a, hn.planes(c)).T == a @ c.T).all()


# ------------------------------------------------------------------ 12
def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, drop):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % drop == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    close = defaultdict(list)
    for a in n:
        for b in n:
            if abs(len(a) - len(b)) < 2 and a != b and near(a, b):
                close[a].append(b)
    form = {}
    for w, k in n.items():
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * k else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, k, len(close[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w, k in n.items()}


def test_variants_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 20)
    monkeypatch.setattr(spelling, "BLOCK", 16)
    monkeypatch.setattr(spelling, "LEAF", 4)
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdeé×"), rng.integers(6, 11))) for _ in range(60)]
    odd = [w[:i] + c + w[i + k:] for w in base for i, c, k in [(int(rng.integers(len(w))), str(rng.choice(list("aeé"))), int(rng.integers(3)))]]
    texts = [" ".join(rng.choice(base, 400)) for _ in range(40)] + [" ".join(rng.choice(odd, 200)) for _ in range(5)]
    long = "ab" * 300
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, "12 .. 漢字 Ā"), (903, (long + " ") * 9), (904, (long + "a ") * 50), (905, (long[:-1] + "x ") * 9), (None, texts[0]), (7, texts[7]), (7, texts[8]),
             (906, "Abcabc ABCABC abcabĉ aaaaaa " * 7), (907, "aaaaaa " * 30 + "aaaaab " * 3), (908, ("x" * 128 + " ") * 9 + ("x" * 129 + " ") * 50 + ("x" * 130 + " ") * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "cell": F.lit(2)})
    for drop in (199, 2):
        got = [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(df, drop=drop).collect()]
        want = brute_variants(rows, drop)
        assert len(got) == len(set(got)) and set(got) == want
        assert any(f and r != f for _, _, _, f, _, r in want) or drop == 199
    assert spelling.variants(df.where("false")).count() == 0


def test_one_edit():
    words = ["", "a", "ab", "abc", "abd", "bc", "aab", "abab", "baba", "abcabc"]
    assert all(spelling.one_edit(a, b) == near(a, b) for a in words for b in words)


# ------------------------------------------------------------------ 13
def brute_lines(rows, least_docs=3, least_chars=20):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(lines.NO_ID if doc is None else doc)
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        own = lines.NO_ID if doc is None else doc
        kept = [x for x in every if not (len(key(x)) >= least_chars and len(held[key(x)]) >= least_docs and max(held[key(x)]) != own)]
        out.append((doc, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = np.random.default_rng(9)
    pool = [f"line number {i} of the pool é" for i in range(200)] + ["short", "", "nineteen characters", "twenty characters!!!", "nineteen charactersé", " not stripped at all, of 30"]
    rows = [(int(i), "\n".join(str(x).upper() if rng.random() < .2 else f"\t{x} \x0b" if rng.random() < .2 else str(x) for x in rng.choice(pool, rng.integers(1, 30)))) for i in rng.permutation(60)]
    hot = "a line that every document holds somewhere"
    rows = [(i, f"{t}\n{hot}") for i, t in rows]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, f"{hot}\r\n" * 20_000), (None, f"{hot}\nfine"), (None, hot), (5, hot), (5, hot), (-3, hot), (904, ("x" * 70_000 + "\n") * 2)]
    return rows + [(905, "x" * 70_000), (906, "X" * 70_000 + " ")]


def test_lines_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "HELD", 300)
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("x"), "gone": F.lit(1), "digest": F.lit(2)}).repartition(7)
    got = sorted(map(tuple, lines.drop_repeated_lines(df).collect()), key=str)
    assert got == brute_lines(rows)
    assert lines.drop_repeated_lines(df.where("false")).count() == 0
    assert sorted(map(tuple, lines.drop_repeated_lines(df, 2, 5).collect()), key=str) == brute_lines(rows, 2, 5)


def test_lines_with_a_full_filter(spark, monkeypatch):
    """A filter with far too few bits lets more lines through and changes nothing."""
    monkeypatch.setattr(lines, "BLOCK_BITS", 1 << 5)
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, lines.drop_repeated_lines(df).collect()), key=str) == brute_lines(rows)


def test_filter_holds_back_single_lines(spark):
    rows = [(i, f"this line belongs to document {i} alone\nthis line belongs to documents {i // 2} and more") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocks = 1
    twice = lines._twice(lines._prints(df, 20, blocks)).collect()
    bits = np.frombuffer(twice[0]["bits"], np.uint8).reshape(1, -1)
    value = spark.sparkContext.broadcast((np.zeros(1, np.int64), bits))
    assert 4000 <= lines._suspects(df, 20, blocks, value).count() < 4100

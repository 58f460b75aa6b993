"""Each operator against brute force, an exact round trip or held-out accuracy, with edge rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bathyspark.llm import decontam, embed_dedup, jaccard, langid, licenses, packing, pii, quality, queries, substring, warc
from tests.llm.conftest import SF


def empty(docs):
    return docs.where("false")


# ------------------------------------------------------------------ 1
def test_decontamination_finds_exact_and_substituted(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    changed = words.copy()
    changed[4] = changed[15] = "other"
    bench = spark.createDataFrame([(1, item), (7, item.upper()), (2, None), (3, "too short"), (4, "one two three four five six")], "item_id long, text string")
    texts = [f"filler words {item} more filler", "x y " + " ".join(changed) + " z", "nothing of the sort", None, "", "before one two three four five six after", " ".join(words[:8])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("region", F.lit(2))
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["overlap_words"], r["matched_words"]) for r in decontam.find_overlaps(docs, bench).collect()}
    assert got == {(0, 1): (2, 20, 20), (1, 1): (2, 20, 18), (5, 4): (1, 6, 6)}
    kept = decontam.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6] and kept.columns == docs.columns
    assert decontam.find_overlaps(docs, bench.where("false")).count() == 0
    assert decontam.find_overlaps(docs.where("false"), bench).count() == 0


def test_decontamination_matches_all_alignments(spark):
    """Whatever the seeds reach is reported as the best of all alignments; exact and one-word-off overlaps always are."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    items = [[str(w) for w in rng.choice(words, int(n))] for n in rng.integers(5, 40, 25)]
    texts, planted = [], []
    for i in range(150):
        t = [str(w) for w in rng.choice(words, int(rng.integers(0, 60)))]
        k = int(rng.integers(25))
        part = list(items[k])
        if len(part) >= 13 and i % 2:
            part[int(rng.integers(len(part)))] = "other"
        at = int(rng.integers(len(t) + 1))
        texts.append(t[:at] + part + t[at:] if i % 3 else t)
        if i % 3:
            planted.append((i, k))
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["overlap_words"], -r["start_word"]) for r in decontam.find_overlaps(frame(texts, "doc_id"), frame(items, "item_id")).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            for off in range(-len(item) + 1, len(t)):
                a, z = max(0, off), min(len(t), off + len(item))
                same = np.array([t[j] == item[j - off] for j in range(a, z)], bool)
                b, e = decontam.best_stretch(same)
                if e - b >= min(13, len(item)):
                    want[i, k] = max(want.get((i, k), (0, 0, 0)), (int(same[b:e].sum()), e - b, -(a + b)))
    assert all(got[x] == want[x] for x in got) and set(planted) <= set(got) and len(got) >= 0.95 * len(want)


def test_decontamination_of_a_long_repeated_text(spark):
    import time
    item, text = "again " * 60, "again " * 180_000
    docs = spark.createDataFrame([(1, text), (2, "again and again")], "doc_id long, text string")
    began = time.time()
    got = decontam.find_overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["overlap_words"]) for r in got] == [(1, 60)] and time.time() - began < 60


# ------------------------------------------------------------------ 2
def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 16))
    near = np.concatenate([base, base[:40] + rng.normal(scale=.08, size=(40, 16)), base[:1] + rng.normal(scale=.05, size=(60, 16)), base[:3]])
    rows = [(i, v.tolist()) for i, v in enumerate(near)]
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0] * 8), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (0, rows[0][1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = embed_dedup.near_vectors(df).collect()
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(near))
    for _ in range(20):
        label = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(label))])
    plain = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert len(got) == len(rows) + len(odd)
    found = sum(min(plain[i]["n_links"], link[i].sum()) for i in range(len(near)))
    assert found >= 0.99 * link.sum()
    assert all(plain[i]["n_links"] <= link[i].sum() for i in range(len(near)))
    assert np.mean([plain[i]["component_id"] == label[i] for i in range(len(near))]) > 0.99
    assert all(plain[i]["n_links"] == 0 and plain[i]["kept"] for i in range(900, 905))
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


def test_vectors_of_several_lengths(spark):
    rng, rows, link = np.random.default_rng(3), [], collections.defaultdict(set)
    for length, n in ((16, 80), (3, 30), (40, 30), (1, 4)):
        base = rng.normal(size=(n, length))
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:n // 2] + rng.normal(scale=.05, size=(n // 2, length))]))]
    rows += [(900, []), (901, [2.0, 0.0, 0.0]), (902, [1.0, 0.0, 0.0]), (903, [1.0, 0.0, 0.0, 0.0])]
    for i, u in rows:
        for j, v in rows:
            if i != j and len(u) == len(v) > 0 and np.dot(u, v) >= .9 * np.linalg.norm(u) * np.linalg.norm(v):
                link[i].add(j)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(link[i]) for i, _ in rows}
    assert got[902]["component_id"] == got[901]["component_id"] and got[903]["kept"] and got[900]["kept"]


def test_vectors_find_rare_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL", 4)  # a grid as large as that of many vectors
    monkeypatch.setattr(embed_dedup, "QUERIES", 64)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(300, 32))
    off -= (off * base[:300]).sum(1, keepdims=True) * base[:300]
    near = .91 * base[:300] + np.sqrt(1 - .91 ** 2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in embed_dedup.near_vectors(df).collect()}
    assert sum(got[8000 + i] == got[i] for i in range(300)) >= 296


# ------------------------------------------------------------------ 3
def test_packing_covers_every_id_once(spark, docs, rows):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(queries.tokenizer()["tokenizer_path"])
    odd = ["abc <|endoftext|> def", "<|endoftext|>", "x  <|endoftext|><|endoftext|>y <|endoftext", "plain words"]
    rng = np.random.default_rng(12)
    odd += ["".join(str(c) for c in rng.choice([" ", "\n", "\t", "a", "Bc", "1", "é", "'s", "!", "\u00a0", "\u2003", "\x1c", "\x85"], int(n), p=[.3, .1, .05, .15, .1, .06, .06, .04, .04, .03, .03, .02, .02]))
            for n in rng.integers(1, 60, 400)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(96000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = rows + [(96000 + i, t) for i, t in enumerate(odd)]
    assert coder.encode(odd[0], add_special_tokens=False).ids == [39305, 220, 50256, 825]
    got = packing.pieces_digest(packing.pack(docs, **queries.tokenizer())).collect()
    ids = collections.defaultdict(list)
    for doc, text in rows:
        ids[doc].append(np.array(coder.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    for doc, every in ids.items():
        assert sum(n for _, n in pieces[doc]) == sum(map(len, every))
        assert sorted(pieces[doc]) == sorted(set(pieces[doc]) if len(every) == 1 else pieces[doc])
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * sum(n for p in pieces.values() for _, n in p)
    assert packing.pack(empty(docs), **queries.tokenizer()).count() == 0


def test_cut_uses_class_sizes():
    sizes = packing.piece_sizes(1024)
    for n in (1, 600, 1023, 1024, 5000):
        assert sum(packing.cut(n, 1024, sizes)) == n and set(packing.cut(n, 1024, sizes)) <= set(sizes)


# ------------------------------------------------------------------ 4
def test_language_held_out_accuracy(spark, docs):
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    got = langid.predict(docs.where("doc_id < 90000"), model, ["doc_id", "lang"]).where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 0
    assert all(0 <= r["score"] <= 1 for r in got)
    edge = {r["doc_id"]: r for r in langid.predict(docs.where("doc_id > 90000"), model).collect()}
    assert all(edge[i]["lang_pred"] == "und" and not edge[i]["accepted"] for i in (90001, 90002, 90003))
    assert edge[90004]["lang_pred"] != "und"
    nothing = langid.predict(docs, langid.train(empty(docs))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_language_rejects_gibberish_and_foreign(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(big.where(~out))
    rng = np.random.default_rng(3)
    letters = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(n)) for n in (300, 300, 300, 300, 1000, 1000, 5000, 100_000)]
    italian = ("Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. "
               "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti e devono agire gli uni verso gli altri in spirito di fratellanza. ")
    coded = base64.b64encode(rng.bytes(4000)).decode()
    planted = [*letters, italian, italian * 10, coded]
    assert [model.predict(t)[2] for t in planted] == [False] * len(planted)
    kept = [r["accepted"] for r in langid.predict(big.where(out), model).collect()]
    assert np.mean(kept) >= 0.9


# ------------------------------------------------------------------ 5
def test_archive_round_trip(spark):
    pages = [(3, "http://c/\r\nX-Page: 9", "same"), (1, "http://a", "same"), (2, "http://b", None), (4, None, ""), (5, "u", "é<b>"), (6, "u", "tiny"), (7, "u", "tiny"), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit("x"))
    archive = warc.write_archive(df, min_bytes=0)
    assert spark.read.parquet(archive.payloads).count() == 4
    got = {r["page_id"]: r for r in warc.read_index(spark, archive).collect()}
    for page, _, html in pages:
        body = (html or "").encode()
        r = got[page]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and r["intact"]
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("revisit", 2), 5: ("response", None), 6: ("response", None), 7: ("revisit", 6), None: ("revisit", 1)}
    for r in warc.read_records(spark, archive).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"(?m)^Content-Length: (\d+)\r?$", head)[1])
        assert block[length:] == b"\r\n\r\n" and r["intact"]
        if b"WARC-Type: response" in head:
            assert block[:length].partition(b"\r\n\r\n")[2] == bytes(r["payload"])
    index = warc.read_index(spark, archive)
    pages = warc.read_pages(spark, archive)
    assert pages.select(index.columns).exceptAll(index).count() == 0 and pages.count() == index.count()
    assert pages.where("intact").count() == pages.count() and pages.where("(html is null) <> (record_type = 'revisit')").count() == 0
    html = {r["page_id"]: bytes(r["payload"]) for r in warc.read_records(spark, archive).collect()}
    assert all(bytes(r["html"]) == html[r["page_id"]] for r in pages.where("html is not null and page_id is not null").collect())
    small = warc.read_index(spark, warc.write_archive(df, min_bytes=10)).collect()
    assert {r["record_type"] for r in small} == {"response"}
    assert warc.read_index(spark, warc.write_archive(df.where("false"))).count() == 0


# ------------------------------------------------------------------ 6
def brute_repeats(rows, n=20):
    first, out = {}, {}
    split = {(d, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    for (d, t), w in sorted(((k, w) for k, w in split.items() if k[0] is not None), key=lambda x: x[0][0]):
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i:i + n]), (d, i))
    for (d, t), w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1 if d is not None else 0):
            if first[tuple(w[i:i + n])] < (d, i):
                gone[i:i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, t] = (d, len(w), sum(gone), kept)
    return [out[r] for r in rows]


@pytest.mark.parametrize("partitions", [1, 23])
def test_substrings_match_brute_force(spark, docs, rows, partitions):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in substring.remove_repeats(docs).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)
    assert substring.remove_repeats(empty(docs)).count() == 0


def test_winnow_covers_every_window():
    g = np.random.default_rng(3).integers(0, 50, 5000).astype(np.uint64) << np.uint64(20)
    at, first, last = substring.winnow(g, 13)
    for p, a, b in zip(at, first, last):
        for w in range(a, b + 1):
            part = g[w:w + 13]
            assert p == w + int(np.argmin(part))
    assert first[0] == 0 and last[-1] == len(g) - 13 and (first[1:] == last[:-1] + 1).all()


# ------------------------------------------------------------------ 7
def test_license_scan(spark):
    apache = licenses.TEMPLATES["Apache-2.0 notice"].split()
    changed = [w if i % 9 else "replaced" for i, w in enumerate(apache)]
    texts = [None, "", "Some text. Released under the MIT License. More.", "Released under the ABC License.", "pre " + " ".join(changed) + " post",
             "Licensed under CC BY-NC 4.0. " * 2, "license " * 500, "the of a " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit(1))
    got = {(r["doc_id"], r["license"]): (r["first_word"], r["matches"]) for r in licenses.scan(df).collect()}
    assert got[2, "MIT line"] == (2, 1) and got[5, "CC-BY-NC-4.0 line"] == (0, 2)
    assert (4, "Apache-2.0 notice") in got and not any(d in (0, 1, 3, 6, 7) for d, _ in got)
    assert licenses.scan(df.where("false")).count() == 0


def test_licenses_match_every_offset():
    """Rare words against an alignment at every offset of text and template, around the wanted coverage."""
    names = ("MIT text", "MPL-2.0 notice", "LGPL notice", "ISC text")
    scanner, rng, seen = licenses.Scanner({n: licenses.TEMPLATES[n] for n in names}, 0.8), random.Random(11), collections.Counter()
    filler = "a the of software use any this permission word other notice in and with 7 license".split()
    for i in range(32):
        t = [w if rng.random() > rng.choice([0.1, 0.2, 0.25]) else "other" for w in licenses.TEMPLATES[names[i % 4]].split()]
        t = t[:9] + rng.choices(filler, k=i % 3) + t[9 + i % 2:]
        text = " ".join(rng.choices(filler, k=rng.randint(0, 40)) + t + rng.choices(filler, k=rng.randint(0, 40)))
        w, want = scanner.words(text).tolist(), set()
        for name, template in scanner.templates.items():
            m = len(template)
            slack = max(2, m // 4)
            for d in range(1 - m, len(w)):
                lo = max(0, d - slack)
                if len(licenses.align(w[lo:max(0, d + m + slack)], template.tolist(), lo)) >= scanner.needed(m):
                    want.add(name)
                    break
        assert {x[0] for x in scanner(text)} == want
        seen[len(want)] += 1
    assert seen[0] and seen[1]


def test_licenses_of_a_text_of_repeated_notices():
    """Matches of one template are set apart in sorted order; they don't overlap."""
    line = licenses.TEMPLATES["MIT line"]
    scanner = licenses.Scanner({"MIT line": line}, 0.8)
    assert scanner(f"{line} " * 40_000) == [("MIT line", 1.0, 0, 4, 40_000)]
    rng = random.Random(2)
    for _ in range(20):
        text = " ".join(rng.choices(line.split(), k=300))
        got = scanner._matches(*(lambda w, k: (w, np.arange(len(w)), k, np.bincount(k, minlength=len(scanner.vocabulary))))(
            w := scanner.words(text), np.searchsorted(scanner.vocabulary, w)), scanner.templates["MIT line"], 0)
        assert all(a[2] < b[1] for a, b in zip(got, got[1:]))


def test_patience_alignment():
    text, template = list("xabcdeYfghz"), list("abcdefgh")
    pairs = licenses.align(text, template)
    assert [template[j] for _, j in pairs] == list("abcdefgh") and all(text[i] == template[j] for i, j in pairs)
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


# ------------------------------------------------------------------ 8
def brute_model(texts, order):
    """Interpolated modified Kneser-Ney straight from its definition."""
    grams = {n: collections.Counter() for n in range(1, order + 1)}
    for t in texts:
        b = bytes(order - 1) + t.encode()
        for i in range(len(b) - order + 1):
            grams[order][b[i:i + order]] += 1
    for n in range(order - 1, 0, -1):
        grams[n] = collections.Counter(g[1:] for g in grams[n + 1])

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[1] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]

    ds = {n: discounts(c) for n, c in grams.items()}
    by = {n: collections.defaultdict(list) for n in grams}
    for n, c in grams.items():
        for g, v in c.items():
            by[n][g[:-1]].append(v)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        seen = by[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        d = lambda v: ds[n][min(v, 3) - 1]
        v = grams[n].get(g, 0)
        return (max(v - d(v), 0) if v else 0) / sum(seen) + sum(map(d, seen)) / sum(seen) * p(g[1:])
    return p


def test_kneser_ney_matches_definition(spark, monkeypatch):
    texts = ["the cat sat on the mat and the dog sat on the log all day long", "a cat and a dog and the mat on the log, the day was long"] * 2
    train = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    model = quality.train(train)
    p = brute_model(texts, quality.ORDER)
    probe = ["the dog sat on the cat all day long and the log", "zzz qqq unseen é bytes \t and the mat on the day"]
    docs = spark.createDataFrame([(1, probe[0], "en"), (2, probe[1], "en"), (3, None, "en"), (4, "short", "en"), (5, probe[0], "xx"), (6, probe[0], None)], "doc_id long, text string, lang string")
    want = {}
    for i, t in enumerate(probe, 1):
        b = bytes(quality.ORDER - 1) + t.encode()
        n = len(b) - quality.ORDER + 1
        want[i] = np.exp(-sum(np.log(p(b[k:k + quality.ORDER])) for k in range(n)) / n)
    for shard in (quality.SHARD, 400):  # one shard, then several
        monkeypatch.setattr(quality, "SHARD", shard)
        got = {r["doc_id"]: r["perplexity"] for r in quality.perplexity(docs, model).collect()}
        assert got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2])
        assert [got[i] for i in (3, 4, 5, 6)] == [None] * 4


def test_quality_keeps_trusted_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).collect()
    kept = {r["quality"]: r["k"] for r in got}
    assert kept[1] > 0.95
    assert quality.classify(empty(docs), labels).count() == 0


def test_quality_drops_each_kind_of_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    kinds = collections.defaultdict(list)
    for r in got:
        first = r["text"].split()[:5]
        junk = "repeated" if len(set(first)) == 1 else "table" if " | " in r["text"] else "symbols"
        kinds["good" if r["quality"] and not r["toxic"] else "toxic" if r["quality"] else junk].append(r["keep"])
    share = {k: (len(v), round(float(np.mean(v)), 3)) for k, v in kinds.items()}
    print(share)
    assert share["good"][1] > 0.97 and share["table"][1] < 0.1 and share["symbols"][1] < 0.05 and share["repeated"][1] < 0.3


# ------------------------------------------------------------------ 9
def brute_jaccard(rows, k=5, least=0.8):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids = [d for d in sets if d is not None]
    links, label = collections.defaultdict(set), {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    for _ in range(30):
        label = {d: min([label[d], *(label[x] for x in links[d])]) for d in ids}
    return {d: (label[d], len(links[d])) for d in ids}


def test_jaccard_matches_brute_force(spark, docs, rows):
    rng, extra = np.random.default_rng(5), []
    base = [f"w{i}" for i in rng.integers(0, 900, 200)]
    for j in range(60):  # a large group of near copies, and its exact copies
        w = list(base)
        w[int(rng.integers(0, 200))] = f"n{j}"
        extra.append((91000 + j, " ".join(w)))
    extra += [(92000 + j, " ".join(base)) for j in range(10)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = jaccard.near_duplicates(every).collect()
    want = brute_jaccard(rows + extra)
    assert len(got) == len(rows) + len(extra)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_links"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert jaccard.near_duplicates(empty(docs)).count() == 0


def test_jaccard_meets_pairs_in_split_nodes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE", 1)  # every node is split, down to the last level
    rng, rows = np.random.default_rng(11), []
    for j in range(600):  # 80 and 100 shingles, 80 of them shared: at the threshold
        w = [f"p{j}x{i}" for i in rng.permutation(104)]
        rows += [(2 * j, " ".join(w)), (2 * j + 1, " ".join(w[:84]))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("doc_id % 2 = 1").collect()
    lost = [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] - 1]
    assert len(got) == 600 and len(lost) <= 4


def test_jaccard_block_pairs_return_only_new_links():
    pdf = pd.DataFrame({"node": 1, "blk_a": 0, "blk_b": 1, "blk": [0, 0, 0, 1, 1, 1], "id": range(6), "sketch": [bytes(jaccard.SKETCH)] * 6})
    assert len(jaccard._sketch_links(pdf, 0.67)) == 1
    assert len(jaccard._sketch_links(pdf.assign(blk_b=0, blk=0), 0.67)) == 5


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other, close = text.replace("word7 ", "another "), text + " more"
    rows = [(1, text, 0), (1, text, 1), (1, text, 2), (2, text, 3), (None, text, 4), (None, text, 5), (None, close, 6), (3, other, 7), (1, "nothing like the text of the first rows at all", 8),
            (None, "rows without an id are copies of each other", 9), (None, "Rows without an id are copies of each other", 10), (5, None, 11), (5, "", 12), (6, close + " " + text[::-1], 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({"uid": F.lit(1), "component_id": F.lit(2), "_order": F.lit("x")}).repartition(3)
    kept = jaccard.drop_near_duplicates(df)
    got = [r["n"] for r in kept.collect()]
    assert kept.columns == df.columns and len(got) == 6
    assert len({0, 1, 2} & set(got)) == 1 and {8, 11, 12, 13} < set(got) and len({9, 10} & set(got)) == 1
    assert jaccard.drop_near_duplicates(df.where("false")).count() == 0


def test_jaccard_sets_with_a_common_passage_are_not_split(spark):
    passage = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"w{i}x{k}" for k in range(160)])) for i in range(400)]
    close = [(i, " ".join(passage + [f"n{k}" for k in range(60) if k != i % 60] + [f"m{i}"])) for i in range(400, 800)]
    df = spark.createDataFrame(rows + close, "doc_id long, text string")
    feats = jaccard._features(df, 5, 15, .8)
    deep = jaccard._leaf_members(feats, jaccard.enough_for(15, .8)).join(feats.select("doc_id", F.explode("paths").alias("p")).where("p.level > 1").select(
        F.col("doc_id").alias("id"), "p.node").distinct(), ["id", "node"])
    split = {r["id"] for r in deep.select("id").collect()}
    assert sum(i < 400 for i in split) < 200 and sum(i >= 400 for i in split) > 300
    got = jaccard.near_duplicates(df).collect()
    want = brute_jaccard(rows + close)
    assert all((r["component_id"], r["n_links"]) == want[r["doc_id"]] for r in got)
    assert jaccard.enough_for(15, .8) == 13


# ------------------------------------------------------------------ 10
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return 9 <= len(d) <= 15 if kind == "phone" else True
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0]))


def test_personal_data(spark, docs, rows):
    odd = ["a@b@c.d a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.004 4111 1111-1111 1111 +1 (743) 555-3824x +12 +123456789", "1 " * 6000 + "4111111111111111",
           "a." * 4000 + "@" + "b." * 3000 + "c", "+1" * 3000, "5" * 6000, "é😀 x@y.zz 😀 10.0.0.1", "mail joe at example dot com", "x@y.zz " * 700]
    every = docs.select("doc_id", "text", F.col("n_chars"), "spans").unionByName(
        spark.createDataFrame([(95000 + i, t, 0, "s") for i, t in enumerate(odd)], "doc_id long, text string, n_chars long, spans string"))
    found = pii.detect(every).select("doc_id", pii.written("base_spans").alias("b"), pii.written("spans").alias("s")).collect()
    texts = collections.defaultdict(list)
    for d, t in rows + [(95000 + i, t) for i, t in enumerate(odd)]:
        texts[d].append(t)
    assert len(found) == sum(map(len, texts.values()))
    for r in found:
        want = brute_spans(texts[r["doc_id"]][0])
        assert r["b"] == want and set(filter(None, want.split(","))) <= set(filter(None, r["s"].split(",")))
    red = {r["doc_id"]: r for r in pii.redact(every).collect()}
    assert red[95005]["text"] == "é😀 [EMAIL] 😀 [IP]" and red[95005]["n_chars"] == len(red[95005]["text"])
    assert red[95003]["spans"] == "s" and red[90001]["text"] is None
    assert pii.detect(empty(docs)).count() == 0


def test_personal_data_adds_loose_spans(spark):
    """Fitted to base spans and failed checks, the trees add loose forms of the same shapes and leave prose, dates and list numbers."""
    rng, rows, loose = random.Random(5), [], {}
    words = "the river stands near our old house and they look at me. Then it goes on with some more of this kind".split()
    text = lambda: " ".join(rng.choices(words, k=12))
    for i in range(400):
        area, line, host = rng.randint(200, 989), rng.randint(1000, 9999), f"{rng.choice('abcd')}site{i}.{rng.choice(['com', 'org', 'de'])}"
        base = [f"+1 ({area}) 555-{line}", f"ann.{i}@{host}", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7"]
        bad = [f"{rng.randint(1, 99)} {rng.randint(10, 99)} {rng.randint(100, 999)}", "look at me. Then it", f"{rng.randint(300, 999)}.1.2.{rng.randint(300, 999)}", f"20{i % 90 + 10}-0{i % 9 + 1}-1{i % 10}"]
        rows.append((i, " ".join(f"{text()} {x} {text()}" for x in base + bad)))
    plant = {"phone": ["(437) 555-0689", "(612) 555-7788"], "email": ["joe.roe at example dot com", "ann.poe [at] example [dot] org"], "ip": ["10[.]20[.]30[.]40"]}
    for kind, all_of in plant.items():
        for x in all_of:
            i, before = len(rows), text() + " "
            loose[i] = (kind, len(before), len(before) + len(x))
            rows.append((i, before + x + " " + text()))
    clean = list(range(len(rows), len(rows) + 40))
    rows += [(i, f"{text()} look at me. Then on 2024-05-1{i % 10} we read 1. 2. 3. 4 and 12 of 300 pages at polka dot dress {text()}") for i in clean]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii.detect(df).select("doc_id", "spans").collect()}
    assert all(span in got[i] for i, span in loose.items()), {i: (s, got[i], dict(rows)[i]) for i, s in loose.items() if s not in got[i]}
    assert not any(got[i] for i in clean), [(got[i], dict(rows)[i]) for i in clean if got[i]][:3]
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert all(red[i] == t[:loose[i][1]] + f"[{loose[i][0].upper()}]" + t[loose[i][2]:] for i, t in rows if i in loose)


def test_personal_data_of_a_text_with_very_many_spans(spark):
    """50,000 spans in one text, beside characters of two sizes: spans are looked up and merged in sorted order."""
    n = 25_000
    text = "é😀 " + "x@y.zz 10.0.0.1 " * n
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, n_chars int")
    red = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert red[1]["text"] == "é😀 " + "[EMAIL] [IP] " * n and red[1]["n_chars"] == len(red[1]["text"])
    assert red[2]["text"] is None and red[3]["text"] == ""


def test_overlapping_spans_become_one(spark):
    """Merged stretches against a plain sweep."""
    rng = random.Random(3)
    lists = [[(rng.choice(pii.KINDS), a, a + rng.randint(1, 9)) for a in (rng.randint(0, 900) for _ in range(k))] for k in (0, 1, 5, 300, 700)]
    text = "".join(rng.choice("abcé😀") for _ in range(5000)) * 2

    def plain(spans):
        out, last = "", 0
        merged = []
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if merged and a < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([kind, a, b])
        for kind, a, b in merged:
            out, last = out + text[last:a] + f"[{kind.upper()}]", b
        return out + text[last:]

    lists = [[(rng.choice(pii.KINDS), 9 * a, 9 * a + b - a) for _, a, b in spans] for spans in lists] + lists
    seen = [list({(a, b): (k, a, b) for k, a, b in spans}.values()) for spans in lists]
    df = spark.createDataFrame([(i, text, s) for i, s in enumerate(seen)], "i long, text string, spans array<struct<kind:string,start:bigint,end:bigint>>")
    got = {r["i"]: r["new"] for r in df.select("i", "text", "spans").transform(pii.masked).collect()}
    assert all(got[i] == plain(s) for i, s in enumerate(seen))


def test_boosting_separates():
    x = np.array([[a, b, 0, 0, 0, 0, 0, 0] for a in range(4) for b in range(4)])
    n = np.full(16, 100.0)
    pos = np.where((x[:, 0] >= 2) & (x[:, 1] <= 1), 99.0, 1.0)
    model = pii.boost(x, n, pos)
    pii.calibrate(model, x, n, pos, 0.95)
    assert ((model.apply(x) >= model.threshold) == (pos > 50)).all()

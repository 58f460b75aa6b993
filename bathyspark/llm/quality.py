"""Text quality by perplexity under an interpolated modified Kneser-Ney model.

One model per language over the UTF-8 bytes of trusted documents (labelled
quality 1, not toxic), of order ``ORDER``: raw counts for the whole n-gram,
continuation counts below, three discounts an order from its counts of counts,
and a uniform distribution under the single bytes.  All counts and
probabilities are grouped aggregations and joins over n-gram codes.

For scoring, the model is dealt into shards by the two bytes that all look-ups
of one position share, so each position is scored by one shard alone.  Texts are
read once, into groups of bounded size that hold their bytes (compressed) and
the distinct n-grams of a group once.  These meet the model's shards in a
sharded, salted join, and its answers come back to the groups, which are a table
bucketed by group and do not move; a text's log probabilities are summed there.
Neither model nor answers pass through the driver.  A tenth of the trusted
documents is not counted but gives, per language, the quantile of perplexity
over which a document is not kept.

Cases: null language is a language of its own (empty name); texts of a
language without trusted text have no perplexity and are kept; so are null texts and
texts of under ``MIN_BYTES`` bytes, which are too short to judge; rows with
equal doc_id and text give one row; documents labelled twice count once, as
untrusted if any label says so; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, staged_by

ORDER, MIN_BYTES, SLICE = 5, 32, 1 << 22
#: Model entries of a shard; groups of texts that one copy of a shard answers.
SHARD, SALT = 1 << 18, 1024
#: Bytes of a chunk and of a group of texts, about.
CHUNK, GROUP = 1 << 21, 1 << 24
#: Positions of a window in which repeated n-grams are counted.
WINDOW = 256


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """The codes of all runs of ``n`` bytes, first byte highest."""
    out = data[:len(data) - n + 1].astype(np.int64)
    for i in range(1, n):
        out = (out << 8) | data[i:len(data) - n + 1 + i]
    return out


def _padded(text: str) -> np.ndarray:
    """The bytes after ``ORDER - 1`` zero bytes."""
    return np.concatenate([np.zeros(ORDER - 1, np.uint8), np.frombuffer(text.encode("utf-8", "replace"), np.uint8)])


def fresh_share(data: np.ndarray) -> float:
    """Mean share of distinct n-grams in windows of about ``WINDOW`` bytes: low where words repeat, whatever the length."""
    code = codes(data, ORDER)
    n = math.ceil(len(code) / WINDOW)
    size, more = divmod(len(code), n)
    # the first windows have one byte more than the others
    sides = code[:more * (size + 1)].reshape(more, size + 1), code[more * (size + 1):].reshape(n - more, size)
    return sum(float((1 + (np.diff(np.sort(x, 1), axis=1) != 0).sum(1)).sum()) / x.shape[1] for x in sides) / n


def _count(batches):
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def out(lang):
        code, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            data = _padded(text.as_py())
            if len(data) < ORDER:
                continue
            for at in range(0, len(data) - ORDER + 1, SLICE):
                held.setdefault(lang, []).append(codes(data[at:at + SLICE + ORDER - 1], ORDER))
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sizes[lang] >= SLICE:
                    yield out(lang)
    for lang in list(held):
        yield out(lang)


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language D1, D2 and D3+ of modified Kneser-Ney from the counts of counts."""
    n = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(i):
        value = F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))).otherwise(F.lit(0.5 * i))
        return F.least(F.greatest(value, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}")

    return counts.groupBy("lang").agg(*n).select("lang", d(1), d(2), d(3))


def train(trusted: DataFrame) -> DataFrame:
    """The model of ``trusted`` (lang, text): rows (lang, n, code, value).

    ``n`` > 0: log probability of the last byte of an n-gram after its others;
    ``n`` < 0: log weight of the shorter n-grams after a context of -n bytes.
    """
    counts = staged(trusted.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "quality-counts")
    by_order = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        shorter = by_order[n + 1].select("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("code"))
        by_order[n] = staged(shorter.groupBy("lang", "code").agg(F.count(F.lit(1)).alias("n")), f"quality-n{n}")
    lower, out = None, None
    for n in range(1, ORDER + 1):
        c = by_order[n].join(F.broadcast(_discounts(by_order[n])), "lang").withColumn("ctx", F.shiftright("code", 8))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = staged(c.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum(d).alias("mass")), f"quality-c{n}")
        top = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")
        rows = c.join(context, ["lang", "ctx"])
        if n == 1:
            p = rows.select("lang", "code", (top + F.col("mass") / F.col("total") / 256).alias("p"))
        else:
            last = lower.select("lang", F.col("code").alias("low"), F.col("p").alias("q"))
            p = (rows.withColumn("low", F.col("code").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(last, ["lang", "low"])
                 .select("lang", "code", (top + F.col("mass") / F.col("total") * F.col("q")).alias("p")))
        lower = staged(p, f"quality-p{n}")
        part = lower.select("lang", F.lit(n).alias("n"), "code", F.log("p").alias("value")).unionByName(
            context.select("lang", F.lit(1 - n).alias("n"), F.col("ctx").alias("code"), F.log(F.col("mass") / F.col("total")).alias("value")))
        out = part if out is None else out.unionByName(part)
    return staged(out, "quality-model")


def _shard_of(n: str = "n", code: str = "code"):
    """The two bytes that all look-ups of a position share: the two before its last; null for tables that every shard has.

    A position's whole code has five bytes; these are its third and fourth.
    """
    k = F.col(n)
    part = {5: 8, 4: 8, 3: 8, -4: 0, -3: 0, -2: 0}
    out = F.lit(None).cast("long")
    for order, shift in part.items():
        out = F.when(k == order, F.shiftright(F.col(code), shift).bitwiseAND(F.lit(0xFFFF))).otherwise(out)
    return out


def _positions(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The codes of all positions of pieces that lie one after the other; a piece's first ``ORDER - 1`` bytes are context."""
    if not len(data):
        return np.empty(0, np.int64)
    ok, ends = np.ones(len(data), bool), np.cumsum(sizes[sizes > 0])
    ok[(ends[:, None] - np.arange(1, ORDER)).ravel()] = False
    return codes(data, ORDER)[ok[:len(data) - ORDER + 1]]


class _Group:
    """Pieces of texts of one language: their bytes in compressed chunks, and the distinct codes of all their positions."""

    def __init__(self):
        self.docs, self.hashes, self.sizes, self.fresh = [], [], [], []
        self.chunks, self.ends, self.seen = [], [], np.empty(0, np.int64)
        self.open, self.size, self.total = [], 0, 0

    def add(self, doc, text_hash, piece: np.ndarray, fresh) -> None:
        for held, value in ((self.docs, doc), (self.hashes, text_hash), (self.sizes, len(piece)), (self.fresh, fresh)):
            held.append(value)
        self.open.append(piece)
        self.size += len(piece)
        self.total += len(piece)
        if self.size >= CHUNK:
            self.close()

    def close(self) -> None:
        start = self.ends[-1] if self.ends else 0
        data = np.concatenate([*self.open, np.empty(0, np.uint8)])
        self.seen = np.union1d(self.seen, np.unique(_positions(data, np.array(self.sizes[start:], np.int64))))
        self.chunks.append(pa.compress(data.tobytes(), "zstd", asbytes=True))
        self.ends.append(len(self.sizes))
        self.open, self.size = [], 0


def _grouped(docs: DataFrame, shards: int) -> DataFrame:
    """One row per group of pieces: g, lang, the pieces, their bytes, and the group's distinct codes by shard (as sorted steps)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        groups: dict[str, _Group] = {}
        number = TaskContext.get().partitionId() << 33

        def out(langs, doc_type):
            nonlocal number
            for lang in langs:
                group = groups.pop(lang)
                if len(group.sizes) > (group.ends[-1] if group.ends else 0):
                    group.close()
                own = shard_number(group.seen >> 8 & 0xFFFF, shards)
                used = np.unique(own)
                number += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([group.docs], pa.list_(doc_type)), pa.array([group.hashes], pa.list_(pa.int64())),
                    pa.array([group.sizes], pa.list_(pa.int32())), pa.array([group.fresh], pa.list_(pa.float64())), pa.array([group.chunks], pa.list_(pa.binary())),
                    pa.array([group.ends], pa.list_(pa.int32())), pa.array([used], pa.list_(pa.int32())),
                    pa.array([[np.diff(group.seen[own == x], prepend=0).tobytes() for x in used]], pa.list_(pa.binary()))],
                    names=["g", "lang", "docs", "hashes", "sizes", "fresh", "chunks", "ends", "shards", "codes"])

        doc_type = None
        for b in batches:
            doc_type = b.schema.field(0).type
            for doc, lang, text, text_hash in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                data = _padded(text.as_py()) if text.is_valid else np.empty(0, np.uint8)
                group = groups.setdefault(lang, _Group())
                if len(data) < MIN_BYTES + ORDER - 1:
                    group.add(doc, text_hash, np.empty(0, np.uint8), None)
                    continue
                fresh = fresh_share(data[ORDER - 1:])
                for at in range(0, len(data) - ORDER + 1, CHUNK):
                    group = groups.setdefault(lang, _Group())
                    group.add(doc, text_hash, data[at:at + CHUNK + ORDER - 1], fresh if not at else None)
                    if group.total >= GROUP:
                        yield from out([lang], doc_type)
            if sum(g.total for g in groups.values()) >= 4 * GROUP:
                yield from out(list(groups), doc_type)
        yield from out(list(groups), doc_type)

    schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("lang", T.StringType()), *[T.StructField(n, T.ArrayType(t)) for n, t in (
        ("docs", kind), ("hashes", T.LongType()), ("sizes", T.IntegerType()), ("fresh", T.DoubleType()), ("chunks", T.BinaryType()), ("ends", T.IntegerType()),
        ("shards", T.IntegerType()), ("codes", T.BinaryType()))]])
    return staged_by(docs.mapInArrow(run, schema), "g", "quality-groups")


def _look(tables: dict, n: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where absent) and whether they are there."""
    keys, values = tables.get(n, (np.empty(0, np.int64), np.empty(0)))
    if not len(keys):
        return np.zeros(len(code)), np.zeros(len(code), bool)
    at = np.searchsorted(keys, code)
    at[at == len(keys)] = 0
    there = keys[at] == code
    return np.where(there, values[at], 0.0), there


def log_prob(tables: dict, code: np.ndarray) -> np.ndarray:
    """Log probability of each code's last byte after its others, from one shard's tables."""
    out, at = np.zeros(len(code)), np.arange(len(code))
    for n in range(ORDER, 0, -1):
        value, there = _look(tables, n, code)
        out[at] += value
        at, code = at[~there], code[~there]
        if not len(at):
            return out
        out[at] += _look(tables, 1 - n, code >> 8)[0]
        code = code & ((1 << 8 * (n - 1)) - 1)
    out[at] -= math.log(256)
    return out


def _answered(batches):
    """Rows sorted by (lang, shard, salt, kind): a shard's tables, then the codes that groups ask it for."""
    key, tables = None, {}
    for b in batches:
        col = {n: b.column(n).to_pylist() for n in ("lang", "shard", "salt", "n", "g", "codes")}
        entries, out = b.column("entries"), []
        for i in range(b.num_rows):
            if (now := (col["lang"][i], col["shard"][i], col["salt"][i])) != key:
                key, tables = now, {}
            if col["codes"][i] is None:
                code, value = (x.to_numpy(zero_copy_only=False) for x in entries[i].values.flatten())
                order = np.argsort(code)
                tables[col["n"][i]] = code[order], value[order]
            else:
                out.append((col["g"][i], key[1], log_prob(tables, np.cumsum(np.frombuffer(col["codes"][i], np.int64))).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
                                             names=["g", "shard", "logs"])


def _summed(batches):
    """Per piece the sum of its positions' log probabilities, and their number."""
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i].as_py() for n in ("lang", "hashes", "sizes", "fresh", "ends", "shards", "codes", "answers")}
            sizes, logs = np.array(row["sizes"], np.int64), {a["shard"]: np.frombuffer(a["logs"]) for a in row["answers"] or ()}
            code = np.concatenate([np.empty(0, np.int64), *(np.cumsum(np.frombuffer(c, np.int64)) for c in row["codes"])])
            log = np.concatenate([np.empty(0), *(logs[x] for x in row["shards"])])
            order = np.argsort(code)
            code, log = code[order], log[order]
            number, total, start = np.maximum(sizes - ORDER + 1, 0), np.zeros(len(sizes)), 0
            for k, end in enumerate(row["ends"]):
                mine = sizes[start:end]
                data = np.frombuffer(pa.decompress(b.column("chunks")[i].values[k].as_py(), int(mine.sum()), "zstd", asbytes=True), np.uint8)
                own = np.repeat(np.arange(end - start), number[start:end])
                total[start:end] = np.bincount(own, log[np.searchsorted(code, _positions(data, mine))], end - start)
                start = end
            docs = b.column("docs")[i].values
            yield pa.RecordBatch.from_arrays([docs, pa.array(row["hashes"], pa.int64()), pa.array([row["lang"]] * len(docs), pa.string()), pa.array(total),
                                              pa.array(number), pa.array(row["fresh"], pa.float64())], names=["doc_id", "text_hash", "lang", "total", "number", "fresh"])


def perplexity(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, perplexity and share of distinct n-grams (null where they can't be judged) of ``docs`` (doc_id, text, lang)."""
    placed = model.withColumn("two", _shard_of())
    shards = max(1, min(1 << 16, math.ceil(placed.where("two is not null").count() / SHARD)))
    keyed = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text", F.xxhash64("text").alias("text_hash"))
    groups = _grouped(keyed, shards)
    salts = max(1, math.ceil(groups.count() / SALT))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    entries = F.collect_list(F.struct("code", "value")).alias("entries")
    # the tables of one and two bytes are part of each shard; they have 66,048 entries a language at most
    own = placed.where("two is not null").withColumn("shard", shard_number(F.col("two"), shards)).groupBy("lang", "shard", "n").agg(entries)
    common = placed.where("two is null").groupBy("lang", "n").agg(entries).withColumn("shard", every(shards))
    tables = own.unionByName(common).select("lang", F.col("shard").cast("int").alias("shard"), every(salts).alias("salt"), F.col("n").cast("int").alias("n"),
                                            F.lit(None).cast("long").alias("g"), "entries", F.lit(None).cast("binary").alias("codes"))
    asked = groups.select("lang", "g", F.explode(F.arrays_zip("shards", "codes")).alias("r")).select(
        "lang", F.col("r.shards").alias("shard"), F.pmod(F.xxhash64("g"), F.lit(salts)).cast("int").alias("salt"), F.lit(None).cast("int").alias("n"), "g",
        F.lit(None).cast("array<struct<code:bigint,value:double>>").alias("entries"), F.col("r.codes").alias("codes"))
    met = tables.unionByName(asked).repartition("lang", "shard", "salt").sortWithinPartitions("lang", "shard", "salt", F.col("codes").isNotNull())
    answers = met.mapInArrow(_answered, "g long, shard int, logs binary").groupBy("g").agg(F.collect_list(F.struct("shard", "logs")).alias("answers"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = groups.join(answers.hint("merge"), "g", "left").mapInArrow(_summed, f"doc_id {kind}, text_hash long, lang string, total double, number long, fresh double")
    both = sums.groupBy("doc_id", "text_hash", "lang").agg(F.sum("total").alias("total"), F.sum("number").alias("number"), F.max("fresh").alias("fresh"))
    known = model.select("lang").distinct().withColumn("known", F.lit(True))
    judged = F.col("known") & (F.col("number") > 0)
    return both.join(known, "lang", "left").select("doc_id", "text_hash", "lang", F.when(judged, F.exp(-F.col("total") / F.col("number"))).alias("perplexity"),
                                                   F.when(judged | F.col("known").isNull(), F.col("fresh")).alias("fresh"))


def shard_number(two, shards: int):
    """The shard of two bytes, as a column or an array: an odd factor deals the 65,536 numbers about anew."""
    if isinstance(two, np.ndarray):
        return (two * 40503 % 65536 * shards) >> 16
    return F.shiftright((two * 40503) % 65536 * shards, 16)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.25) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic).

    The threshold of a language is ``slack`` times the quantile of the trusted
    documents that were not counted.  A document whose windows hold less than half
    the distinct n-grams of the least varied such documents (1 - ``quantile``) isn't kept either.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select(F.col("doc_id").alias("good_id"))
    named = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    trusted = staged(named.where("text is not null").join(good, F.col("doc_id") == F.col("good_id"), "left_semi").select("doc_id", "lang"), "quality-trusted")
    aside = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("aside")), F.lit(10)) == 0
    counted = trusted.where(~aside).select(F.col("doc_id").alias("good_id")).distinct()
    model = train(named.where("text is not null").join(counted, F.col("doc_id") == F.col("good_id"), "left_semi"))
    scores = staged(perplexity(docs, model), "quality-perplexity")
    limit = (scores.join(trusted.where(aside).select("doc_id").distinct(), "doc_id").where("perplexity is not null").groupBy("lang")
             .agg((slack * F.percentile_approx("perplexity", quantile, 10_000)).alias("threshold"),
                  (F.percentile_approx("fresh", 1 - quantile, 10_000) / 2).alias("least")))
    return (scores.join(F.broadcast(limit), "lang", "left")
            .select("doc_id", "lang", "perplexity", "threshold",
                    F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("fresh") >= F.col("least")), F.lit(True)).alias("keep")))

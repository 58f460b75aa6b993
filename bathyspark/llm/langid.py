"""Language identification by nearest centroid.

A text's letters give counts of byte n-grams (one to three bytes of the
lower-cased UTF-8, words apart), hashed into a fixed number of features and
weighed by TF-IDF; document frequencies come from all training documents.
Each language has several centroids, found by spherical k-means over a bounded
sample of its documents (``sample_per_lang`` rows, the smallest hashes of
doc_id).  A text gets the language of the centroid with the largest cosine.
A text whose cosine lies below a floor for its language and length is
rejected; floors are a low quantile among the quarter of the sample that no
centroid is fitted to, of the nearest lengths.

Cases: a null text, or one without a letter, is ``und``, score 0, rejected;
null or unlabelled rows are never learnt from but are predicted; with nothing
to learn from every text is ``und``; repeated rows get the same answer; whole
texts are read in slices of bounded size; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 13
DIM = 1 << BITS
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that stay: a to z, and all of multi-byte characters; the rest part words.
KEEP = np.full(256, 0x20, np.uint8)
KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
KEEP[0x80:] = np.arange(0x80, 0x100)
CHUNK = 1 << 20
#: Length classes, more than any text has.
KINDS = 48


def counts(text: str | None) -> np.ndarray | None:
    """Feature counts of a whole text; None where it has no letter."""
    if not text:
        return None
    data = text.lower().encode("utf-8", "replace")
    b = KEEP[np.frombuffer(data, np.uint8)]
    if not (b != 0x20).any() or not ((b < 0x80) & (b != 0x20)).any() and not LETTER.search(text):
        return None
    out = np.zeros(DIM, np.int64)
    padded = np.concatenate([[0x20], b, [0x20] * 3]).astype(np.uint8)
    for at in range(0, len(b) + 1, CHUNK):  # n-grams that start here, slice by slice
        x = padded[at:min(at + CHUNK, len(b) + 1) + 2].astype(np.uint32)
        sp = x == 0x20
        two = (x[:-1] << np.uint32(8)) | x[1:]
        three = (two[:-1] << np.uint32(8)) | x[2:]
        n = len(three)
        for code, skip in ((x[:n], sp[:n]), (two[:n] + np.uint32(1 << 24), sp[:n] & sp[1:n + 1]),
                           (three + np.uint32(1 << 25), sp[1:n + 1] | (sp[:n] & sp[2:]))):
            code = code[~skip] * np.uint32(0x9E3779B1)
            out += np.bincount(code >> np.uint32(32 - BITS), minlength=DIM)
    return out


def weigh(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero features and their normalised TF-IDF weights."""
    at = np.flatnonzero(count)
    v = np.log1p(count[at]) * idf[at]
    n = np.linalg.norm(v)
    return at, (v / n if n else v).astype(np.float32)


def cluster(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts at the mean's nearest row and adds the row farthest from all before."""
    mean = rows.mean(0)
    picked = [int(np.argmax(rows @ mean))]
    near = rows @ rows[picked[0]]
    while len(picked) < min(k, len(rows)):
        far = int(np.argmin(near))
        picked.append(far)
        near = np.maximum(near, rows @ rows[far])
    centre = rows[picked]
    for _ in range(rounds):
        own = np.argmax(rows @ centre.T, 1)
        centre = np.stack([rows[own == j].mean(0) if (own == j).any() else centre[j] for j in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def length_class(count: np.ndarray) -> int:
    return int(np.log2(1 + count.sum()))


@dataclass
class Model:
    """Weights, centroids (rows) with their language, and floors by (language, length class)."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: dict[tuple[str, int], float]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        c = counts(text)
        if c is None or not len(self.langs):
            return "und", 0.0, False
        at, v = weigh(c, self.idf)
        cos = v @ self.columns[at]
        j = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[j])))
        return self.langs[j], score, score >= self.floors.get((self.langs[j], length_class(c)), 0.0)

    @property
    def columns(self) -> np.ndarray:
        if "_columns" not in self.__dict__:
            self._columns = np.ascontiguousarray(self.centroids.T)
        return self._columns


def _frequencies(batches):
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            c = counts(text.as_py())
            if c is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "n"])


def train(docs: DataFrame, clusters: int = 4, sample_per_lang: int = 1500, quantile: float = 0.005) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that have a text and a language.

    To the driver come one row per feature (at most 8,193), and per language
    ``clusters`` centroids and a floor per length class.
    """
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    df = dict(known.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").cast("long")).collect())
    total = df.pop(-1, 0)
    idf = np.zeros(DIM)
    for f, n in df.items():
        idf[f] = np.log((1 + total) / (1 + n)) + 1
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return Model(idf, np.zeros((0, DIM), np.float32), [], {})
    # rows under a hash bound hold about twice the sample; of these the smallest hashes are taken
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2 * sample_per_lang / n)))])[F.col("lang")]
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    from pyspark.sql import Window
    few = (known.where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20))
           .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text"))))
           .where(F.col("rank") <= sample_per_lang).select("lang", "text"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(t, c) for t, c in zip(pdf["text"], map(counts, pdf["text"])) if c is not None]
        texts, got = [t for t, _ in pairs], [c for _, c in pairs]
        if not got:
            return pd.DataFrame({"lang": [], "kind": [], "at": [], "value": []})
        rows = np.zeros((len(got), DIM), np.float32)
        for i, c in enumerate(got):
            at, v = weigh(c, idf)
            rows[i, at] = v
        aside = np.array([zlib.crc32(t.encode("utf-8", "replace")) % 4 == 0 for t in texts])
        if aside.all() or not aside.any():  # too few texts to part
            centre, aside = cluster(rows, clusters), np.ones(len(rows), bool)
        else:
            centre = cluster(rows[~aside], clusters)
        best = (rows[aside] @ centre.T).max(1)
        kinds = np.array([length_class(c) for c, a in zip(got, aside) if a])
        out = [("centroid", j, c.astype("<f4").tobytes()) for j, c in enumerate(centre)]
        for k in range(KINDS):
            away = np.abs(kinds - k)
            near = best[away <= max(1, np.sort(away)[:20][-1])]
            out.append(("floor", k, np.array([np.quantile(near, quantile)], "<f4").tobytes()))
        return pd.DataFrame([(pdf["lang"].iloc[0], *x) for x in out], columns=["lang", "kind", "at", "value"])

    got = few.groupBy("lang").applyInPandas(fit, "lang string, kind string, at long, value binary").collect()
    cents = sorted((r["lang"], r["at"], r["value"]) for r in got if r["kind"] == "centroid")
    floors = {(r["lang"], r["at"]): float(np.frombuffer(r["value"], "<f4")[0]) for r in got if r["kind"] == "floor"}
    matrix = np.stack([np.frombuffer(v, "<f4") for *_, v in cents]) if cents else np.zeros((0, DIM), np.float32)
    return Model(idf, matrix, [c[0] for c in cents], floors)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) of all rows, with lang_pred, score and accepted."""
    keep = keep or ["doc_id"]
    names = [*keep, "text"] if "text" not in keep else keep
    sent = docs.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.langs, model.floors))  # plain data: workers need not have this package
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    place, n_keep = names.index("text"), len(keep)

    def run(batches):
        m = Model(*sent.value)
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(place)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n_keep)], pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id's text falls in the fold that is never learnt from (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))

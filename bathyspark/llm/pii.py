"""Personal data: candidate spans, boosted trees, calibrated thresholds; built-in functions only.

Base patterns (email, ip, card, phone) with their checks give spans that
always stay.  Looser generators propose more spans of the same kinds: spelled
or bracketed addresses, defanged numbers, other separators, numbers without a
country prefix.  Evidence labels some proposals: positive where they meet a
base span of their kind; negative where a check says no (digit count, check
digit, octets, top-level name, a full stop before white space, a date, a base
span of another kind).  The others are unlabelled and take no part in
fitting.  Gradient-boosted trees see small whole numbers of format and
context that the evidence doesn't look at; they are fitted to the counts
of each feature combination, which are aggregated over all documents and bounded
by the features' ranges, so the driver fits the trees on a small table.
Half of the documents are for fitting; on the others each kind's threshold
is the lowest at which labelled proposals over it are positive at the target
precision, but not below even odds.  Unlabelled proposals over it are added.  Trees become SQL expressions.

Every step is within a row; only feature counts are shuffled.  Proposals are
found once, in a written table that both the fitting and the selection read.

Cases: null text is empty; empty texts have no span; patterns are written
without nested backtracking, so very long runs are read once, and spans are looked up and
merged in sorted order, so a text of very many spans is no product; repeated rows
and null ids are rows like others; with no positive example nothing is added;
an empty table gives no row; other columns are kept by ``redact`` and not read
otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
# Patterns of the base kinds.  Runs are possessive and don't begin inside a run (but
# may begin where the match before ended), so each is the leftmost match of the plain pattern, found in one pass.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Patterns of the generators.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?| at | ?@ ?)[A-Za-z0-9-]{1,63}+(?:(?: ?[\[(]dot[\])] ?| dot | ?\. ?)[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4,19}+(?:[\x20._/-]{1,2}+[0-9]{1,6}+){0,6}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+ ?)?\(?[0-9]{1,4}+\)?(?:[\x20./-]{0,2}\(?[0-9]{2,5}+\)?){2,5}+(?![0-9])",
}
# Words that often stand before each kind.
NEAR = {
    "email": r"(?i)(e-?mail|mail|contact|write)\W*$",
    "ip": r"(?i)(\bip|host|server|address|addr)\W*$",
    "card": r"(?i)(card|visa|credit|carte|karte|tarjeta)\W*$",
    "phone": r"(?i)(tel|phone|call|mobile|fax|telefon|tél|móvil)\W*$",
}
CONTEXT = 24
# Generic top-level names; names of two letters are countries'.
TOP = "com|org|net|edu|gov|mil|int|info|biz|name|app|dev"
# Fixed value: a date of year, month and day with equal separators.
DATE = r"^(?:19|20)[0-9]{2}([-./ ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])(?![0-9])"
FEATURES = {
    "email": ("top", "local", "groups", "near", "before", "after"),
    "ip": ("digits", "first", "near", "before", "after"),
    "card": ("digits", "first", "groups", "near", "before", "after"),
    "phone": ("tail", "bracket", "near", "before", "after"),
}
WIDTH = max(map(len, FEATURES.values()))
BLOCK = 256
CHUNK = 4096


def _running(values: Column, both=lambda a, b: a + b) -> Column:
    """Sums (or another ``both``, from 0) of all elements before each of an array column, in blocks so that long arrays stay linear."""
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int") - 1)),
                         lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def prefix(x):
        state = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("before"))
        step = lambda s, v: F.struct(both(s["sum"], v).alias("sum"), F.array_append(s["before"], s["sum"]).alias("before"))
        return F.aggregate(x, state, step, lambda s: s["before"])

    total = prefix(F.transform(blocks, lambda b: F.aggregate(b, zero, both)))
    return F.flatten(F.zip_with(blocks, total, lambda b, t: F.transform(prefix(b), lambda v: both(v, t))))


def _find(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add for each (name: pattern, gate) an array of (start, end, found, before, after) of the matches in the column ``text``.

    ``split`` gives what lies between the matches, so their places are sums of
    lengths.  Each step is a projection of columns that the next one reads more
    than once, which keeps the optimiser from evaluating them inside lambdas.
    ``gate`` is a cheap condition that holds wherever there is a match.
    """
    none = F.array().cast("array<string>")
    col = lambda n, part: f"{n}__{part}"

    def steps(n):
        m, p = col(n, "m"), col(n, "p")
        pairs = F.arrays_zip(F.col(m).alias("m"), F.slice(p, F.lit(1), F.size(m)).alias("p"), F.slice(p, F.lit(2), F.size(m)).alias("q"))
        return F.transform(pairs, lambda x: F.struct(
            x["m"].alias("found"), F.length(x["m"]).cast("long").alias("n"), F.length(x["p"]).cast("long").alias("gap"),
            F.substring(x["p"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["q"], 1, CONTEXT).alias("after")))

    def placed(n):
        return F.zip_with(col(n, "z"), col(n, "r"), lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["found"].alias("found"), x["before"].alias("before"), x["after"].alias("after")))

    some = lambda n, part, value: F.when(F.size(col(n, part)) > 0, value)
    df = df.withColumns({col(n, "m"): F.when(gate, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, (p, gate) in patterns.items()})
    df = df.withColumns({col(n, "p"): some(n, "m", F.split(text, p, -1)).otherwise(none) for n, (p, _) in patterns.items()})
    df = df.withColumns({col(n, "z"): steps(n) for n in patterns})
    df = df.withColumns({col(n, "l"): F.transform(col(n, "z"), lambda x: x["n"] + x["gap"]) for n in patterns})
    df = df.withColumns({col(n, "r"): some(n, "l", _running(F.col(col(n, "l")))).otherwise(F.col(col(n, "l"))) for n in patterns})
    return df.withColumns({n: placed(n) for n in patterns}).drop(*[col(n, part) for n in patterns for part in "mpzlr"])


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits (not empty) passes the Luhn check."""
    def add(s, i):
        v = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return s + F.when(i % 2 == 0, twice).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def octet(s: Column) -> Column:
    """Whether a string of digits is at most 255."""
    v = F.regexp_replace(s, "^0+", "")
    return F.when(F.length(v) < 3, F.lit(True)).when(F.length(v) == 3, v <= "255").otherwise(F.lit(False))


def _luhn_card(s: Column) -> Column:
    d = digits_of(s)
    return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))


def _check(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), octet)
    if kind == "card":
        return _luhn_card(s)
    if kind == "phone":
        return F.length(digits_of(s)).between(9, 15)
    return F.lit(True)


def _char_class(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}_]$"), 1).otherwise(2)


def _features(kind: str, x: Column) -> Column:
    """Small whole numbers of a proposal, none of which the evidence of its kind reads but ``top`` (4,096 combinations at most)."""
    s = x["found"]
    d, n = digits_of(s), F.length(digits_of(s))
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    last = lambda i: F.length(F.coalesce(F.get(groups, F.size(groups) - i), F.lit("")))
    local = F.length(F.regexp_extract(s, r"^[A-Za-z0-9._%+-]+", 0))
    value = {
        "top": _top(s),
        "local": F.when(local < 2, 0).when(local < 5, 1).when(local < 25, 2).otherwise(3),
        "digits": F.when(n < 7, 0).when(n < 9, 1).when(n < 11, 2).when(n < 13, 3).when(n < 15, 4).when(n == 15, 5).when(n == 16, 6).otherwise(7),
        "first": F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(0)),
        "groups": F.least(F.lit(4), F.size(groups) if kind == "card" else F.size(F.split(s, r"(?i)\.|\bdot\b"))),
        "tail": F.when((last(1) == 4) & (last(2).between(2, 4)), 3).when((last(1) == 2) & (last(2) == 2), 2).when(last(1) == 3, 1).otherwise(0),
        "bracket": F.contains(s, F.lit("(")).cast("int"),
        "near": x["before"].rlike(NEAR[kind]).cast("int"),
        "before": _char_class(F.substring(x["before"], -1, 1)),
        "after": _char_class(F.substring(x["after"], 1, 1)),
    }
    return F.struct(*[value[f].alias(f) for f in FEATURES[kind]])


def _top(s: Column) -> Column:
    """2: a generic top-level name, 1: one of two letters, 0: anything else."""
    return F.when(s.rlike(rf"(?i)[^A-Za-z0-9-](?:{TOP})$"), 2).when(s.rlike(r"[^A-Za-z0-9-][A-Za-z]{2}$"), 1).otherwise(0)


def _fails(kind: str, x: Column) -> Column:
    """Whether a check says that a proposal is not of its kind."""
    s = x["found"]
    d = digits_of(s)
    if kind == "email":
        return (_top(s) == 0) | s.rlike(r"[A-Za-z0-9]\.\s")
    if kind == "ip":
        return ~F.forall(F.filter(F.split(s, "[^0-9]+"), lambda g: g != ""), octet) | s.rlike(r"[0-9]\.\s")
    if kind == "card":
        return ~_luhn_card(s)
    return ~F.length(d).between(9, 15) | s.rlike(DATE) | _meets("base_ip", x) | _meets("base_card", x)


def _meets(spans: str, x: Column) -> Column:
    """Whether x overlaps one of ``spans`` (by start, apart from each other): the last that starts before x ends, by halving."""
    def step(at, s):
        return F.when(F.get(spans, at + s - 1)["start"] < x["end"], at + s).otherwise(at)
    steps = F.filter(F.array(*[F.lit(2 ** i) for i in range(30, -1, -1)]), lambda s: s <= F.size(spans))
    return F.coalesce(F.get(spans, F.aggregate(steps, F.lit(0), step) - 1)["end"] > x["start"], F.lit(False))


def _checked(kind: str) -> Column:
    good = F.filter(f"base_{kind}", lambda x: _check(kind, x["found"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _proposed(kind: str) -> Column:
    label = lambda x: F.when(_meets(f"base_{kind}", x), 1).when(_fails(kind, x), 0)
    return F.transform(f"more_{kind}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), label(x).alias("label"), _features(kind, x).alias("f")))


def _examples(kind: str) -> Column:
    """The labelled proposals, their features by place."""
    features = lambda x: F.array(*[x["f"][f] for f in FEATURES[kind]], *[F.lit(0)] * (WIDTH - len(FEATURES[kind])))
    return F.transform(F.filter(f"more_{kind}", lambda x: x["label"].isNotNull()),
                       lambda x: F.struct(F.lit(kind).alias("kind"), x["label"].alias("label"), features(x).alias("f")))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with, per kind, ``base_<kind>`` (start, end) and ``more_<kind>`` (start, end, label: 1, 0 or null, f: features)."""
    body = "_pii_text"
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    digit, at = F.col(body).rlike("[0-9]"), F.contains(F.col(body), F.lit("@"))
    gates = {"base_email": at, "base_ip": digit, "base_card": digit, "base_phone": F.contains(F.col(body), F.lit("+")),
             "more_email": at | F.col(body).rlike(r"(?i)[\[(]at[\])]| at .{1,64} dot "), "more_ip": digit, "more_card": digit, "more_phone": digit}
    df = _find(df, body, {n: ((BASE if n.startswith("base") else LOOSE)[n[5:]], gate) for n, gate in gates.items()})
    df = df.withColumns({f"base_{k}": _checked(k) for k in KINDS})
    return df.withColumns({f"more_{k}": _proposed(k) for k in KINDS}).drop(body)


@dataclass
class Trees:
    """Boosted trees of one kind: each (feature, cut, feature low, cut low, feature high, cut high, four leaf values); a threshold."""

    names: tuple[str, ...] = ()
    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    threshold: float = math.inf

    def score(self, f: Column) -> Column:
        out = F.lit(self.bias)
        for a, ca, b, cb, c, cc, leaves in self.trees:
            low = F.when(f[self.names[b]] <= cb, leaves[0]).otherwise(leaves[1])
            high = F.when(f[self.names[c]] <= cc, leaves[2]).otherwise(leaves[3])
            out = out + F.when(f[self.names[a]] <= ca, low).otherwise(high)
        return out

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for a, ca, b, cb, c, cc, leaves in self.trees:
            out += np.where(x[:, a] <= ca, np.where(x[:, b] <= cb, leaves[0], leaves[1]), np.where(x[:, c] <= cc, leaves[2], leaves[3]))
        return out


def _split(x, g, h, rows, lam=1.0):
    """The best (feature, cut) of these rows by the gain of Newton steps, and the two sides' steps."""
    best = (-1.0, 0, 10**6)
    for j in range(x.shape[1]):
        for cut in np.unique(x[rows, j])[:-1]:
            low = x[rows, j] <= cut
            gl, hl = g[rows][low].sum(), h[rows][low].sum()
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            gain = gl * gl / (hl + lam) + gr * gr / (hr + lam)
            if gain > best[0]:
                best = (gain, j, int(cut))
    _, j, cut = best
    low = rows[x[rows, j] <= cut]
    high = rows[x[rows, j] > cut]
    return j, cut, low, high, [-(g[r].sum()) / (h[r].sum() + lam) for r in (low, high)]


def boost(x: np.ndarray, n: np.ndarray, pos: np.ndarray, names: tuple[str, ...] = (), rounds: int = 20, rate: float = 0.3) -> Trees:
    """Logistic boosting of depth-two trees on counts: ``n`` proposals and ``pos`` positive ones per row of ``x``."""
    rate0 = (pos.sum() + 0.5) / (n.sum() + 1)
    model = Trees(names, bias=float(math.log(rate0 / (1 - rate0))))
    score, every = np.full(len(x), model.bias), np.arange(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = n * p - pos, n * p * (1 - p)
        a, ca, low, high, _ = _split(x, g, h, every)
        b, cb, _, _, left = _split(x, g, h, low)
        c, cc, _, _, right = _split(x, g, h, high)
        tree = (a, ca, b, cb, c, cc, [round(float(rate * v), 6) for v in left + right])
        model.trees.append(tree)
        score = model.apply(x)
    return model


def calibrate(model: Trees, x: np.ndarray, n: np.ndarray, pos: np.ndarray, precision: float) -> None:
    """Set the lowest threshold over which the share of positives is at least ``precision``, but not below even odds."""
    score = model.apply(x)
    order = np.argsort(-score, kind="stable")
    tn, tp = np.cumsum(n[order]), np.cumsum(pos[order])
    last = np.append(np.diff(score[order]) != 0, True) if len(order) else np.zeros(0, bool)
    ok = np.flatnonzero(last & (tp >= precision * tn))
    model.threshold = max(0.0, float(score[order][ok[-1]]) - 1e-9) if len(ok) else math.inf


def train(found: DataFrame, key: str = "doc_id", precision: float = 0.95) -> dict[str, Trees]:
    """Fit and calibrate each kind on the labelled proposals of ``candidates`` over all documents, two folds by a hash of ``key``."""
    fold = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    rows = found.select(fold, F.explode(F.concat(*map(_examples, KINDS))).alias("x"))
    got = rows.groupBy("fold", "x.kind", *[F.get("x.f", i).alias(f"f{i}") for i in range(WIDTH)]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x.label").cast("long")).alias("pos")).collect()
    out = {}
    for kind in KINDS:
        names = FEATURES[kind]
        part = sorted((tuple(int(r[f"f{i}"]) for i in range(len(names))), r["fold"], r["n"], r["pos"]) for r in got if r["kind"] == kind)
        sides = []
        for f in (0, 1):
            mine = [r for r in part if r[1] == f]
            sides.append((np.array([r[0] for r in mine], int).reshape(len(mine), len(names)), np.array([r[2] for r in mine], float), np.array([r[3] for r in mine], float)))
        if not len(sides[0][0]) or not sides[0][2].sum():
            out[kind] = Trees()
            continue
        out[kind] = boost(*sides[0], names)
        calibrate(out[kind], *sides[1], precision)
    return out


def spans(found: DataFrame, model: dict[str, Trees]) -> DataFrame:
    """``candidates`` with ``spans``: all (kind, start, end), by kind and start, and ``base_spans`` of the base ones."""
    def named(kind, source):
        return F.transform(source, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def added(kind):
        trees = model[kind]
        if math.isinf(trees.threshold):
            return F.slice(F.col(f"more_{kind}"), 1, 0)
        return F.filter(f"more_{kind}", lambda x: x["label"].isNull() & (trees.score(x["f"]) >= trees.threshold))

    by_start = lambda a: F.array_sort(a, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))
    both = [by_start(F.concat(named(k, F.col(f"base_{k}")), named(k, added(k)))) for k in KINDS]
    base = F.concat(*[named(k, F.col(f"base_{k}")) for k in KINDS])
    return found.withColumn("base_spans", base).withColumn("spans", F.concat(*both)).drop(*[f"more_{k}" for k in KINDS])


def written(array: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame, key: str = "doc_id", precision: float = 0.95) -> DataFrame:
    """``key`` and, for each row, base_<kind>, base_spans and spans."""
    found = staged(candidates(docs.select(key, "text")).drop("text"), "pii-found")
    return spans(found, train(found, key, precision))


def masked(df: DataFrame) -> DataFrame:
    """``df`` with ``new``: ``text``, its ``spans`` replaced by their kind's name in brackets; spans that overlap are one."""
    first = F.array_sort(F.col("spans"), lambda x, y: F.when((x["start"] < y["start"]) | (x["start"] == y["start"]) & (x["end"] > y["end"]), -1)
                         .when((x["start"] == y["start"]) & (x["end"] == y["end"]), 0).otherwise(1))
    df = df.withColumn("first", first)
    df = df.withColumn("reach", _running(F.transform("first", lambda x: x["end"]), lambda a, b: F.greatest(a, b)))
    df = df.withColumn("heads", F.filter(F.zip_with("first", "reach", lambda x, r: x.withField("end", r)), lambda x: x["start"] >= x["end"]))
    ends = F.concat(F.transform(F.slice("heads", F.lit(2), F.size("heads")), lambda x: x["end"]), F.array(F.array_max(F.transform("first", lambda x: x["end"]))))
    df = df.withColumn("apart", F.when(F.size("first") > 0, F.zip_with("heads", ends, lambda x, e: x.withField("end", e))).otherwise(F.col("heads")))
    df = df.withColumn("chunks", F.when(F.size("apart") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CHUNK}}}+"), F.lit(0))))

    def piece(a, b):
        at = F.floor(a / CHUNK).cast("int")
        some = F.slice("chunks", at + 1, F.floor(b / CHUNK).cast("int") - at + 1)
        return F.substring(F.array_join(some, ""), (a % CHUNK + 1).cast("int"), (b - a).cast("int"))

    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("apart", lambda x: x["end"]))
    parts = F.zip_with(F.col("apart"), F.slice(ends, F.lit(1), F.size("apart")), lambda x, a: F.concat(piece(a, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = piece(F.element_at(ends, -1), F.length("text").cast("long"))
    new = F.when(F.size("apart") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text"))
    return df.withColumn("new", new).drop("first", "reach", "heads", "apart", "chunks")


def redact(docs: DataFrame, key: str = "doc_id", precision: float = 0.95) -> DataFrame:
    """``docs``, its spans replaced in text by the kind's name in brackets (spans that overlap are one); n_chars follows, if there."""
    plain = docs.select(F.col(key).alias("_key"), "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("_row"))
    found = staged(candidates(plain), "pii-found")
    df = spans(found, train(found, "_key", precision)).select("_row", "text", "spans")
    df = masked(df)
    kept = {c: F.col("new") if c == "text" else F.col("_row")[c] for c in docs.columns}
    if "n_chars" in kept:
        kept["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return df.select([v.alias(c) for c, v in kept.items()])

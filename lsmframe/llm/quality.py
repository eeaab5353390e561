"""Quality classifier: a sparse rule ensemble over text statistics.

Small trees are grown on a bounded sample of labelled rows; every path from a root becomes a rule, a conjunction of
thresholds. Lasso logistic regression weights the rules (most get none), and the rules left are compiled into one Spark
column expression over the statistics columns. Statistics are taken of every whole text.

Null and empty texts have statistics of 0 and are scored like others. Null labels are not learnt from; a document labelled
more than once counts with its least label; with no labelled rows, one class only, or too few rows for a rule, the score is
the smoothed share of label 1. Repeated rows each get their row; an empty table gives none. The statistics take names that clash with no column; a
column named as the result gives way to it in `score`; `stage` gives back all columns as they were.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, free_name, slices, table, text_list, tidy

THRESHOLD = 0.3
STATS = ["log_bytes", "log_words", "word_len", "upper", "digit", "stop_sign", "comma", "pipe", "bang", "odd_sign", "odd_words", "upper_words", "distinct", "top_word", "runs", "line_len", "same_lines", "odd_lines"]
PREFIX = "_q_"

#: What kind of byte each one is: letters, capitals, digits, white space, signs by use.
KIND = np.zeros(256, np.uint8)
for kind, members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"|", b"!?", b"#$%&*@^~<>=+_{}[]\\/"), 1):
    KIND[list(members)] = kind


def statistics(text: str) -> list[float]:
    """STATS of a text, each a share, a mean or a logarithm."""
    if not text:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text.encode(), np.uint8)
    k = np.bincount(KIND[raw], minlength=8) / len(raw)
    words = text.split()
    n = max(1, len(words))
    found = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    odd = [w for w in found if not w[-1].isalnum() and w[-1] not in ".,"]
    upper = sum(c for w, c in found.items() if len(w) > 1 and w.isupper())
    bad_lines = sum(len(x) for x in lines if x.isupper() or x.count("|") * 12 > len(x))
    return [math.log1p(len(raw)), math.log1p(len(words)), len(raw) / n, k[1], k[2], k[3], k[4], k[5], k[6], k[7], sum(found[w] for w in odd) / n, upper / n, len(found) / n ** 0.75, max(found.values(), default=0) / n,
            sum([a == b for a, b in zip(words, words[1:], strict=False)]) / n, math.log1p(len(raw) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), bad_lines / max(1, len(text))]


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = PREFIX) -> DataFrame:
    """docs with the statistics of their texts added, named prefix and statistic."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, at)):
            x = np.array([statistics(t) for t in text_list(b.column(at))], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[:, j]) for j in range(len(STATS)))], [*b.schema.names, *(prefix + s for s in STATS)])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *(T.StructField(prefix + s, T.DoubleType()) for s in STATS)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, tries: np.ndarray, rng, path: Rule = ()) -> list[Rule]:
    """Paths of one tree: the best Gini split of a random half of the statistics, down to `depth`."""
    rules = [path] if path else []
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return rules
    best = (1e-9, -1, 0.0)
    total, ones = w.sum(), (w * y).sum()
    base = ones * (total - ones) / total
    for j in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        for t in np.unique(np.quantile(x[:, j], tries)):
            up = x[:, j] > t
            a, b = w[up].sum(), (w * y)[up].sum()
            if 0 < a < total and 10 <= up.sum() <= len(y) - 10:
                gain = base - b * (a - b) / a - (ones - b) * (total - a - ones + b) / (total - a)
                if gain > best[0]:
                    best = (gain, int(j), float(t))
    _, j, t = best
    if j < 0:
        return rules
    up = x[:, j] > t
    for above, rows in ((True, up), (False, ~up)):
        rules += grow(x[rows], y[rows], w[rows], depth - 1, tries, rng, (*path, (j, above, t)))
    return rules


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    n, m = z.shape
    b0, b = math.log((y.sum() + 1) / (n - y.sum() + 1)), np.zeros(m)
    v0, v, t = b0, b.copy(), 1.0
    rate = 4.0 / (1 + np.linalg.norm(z, 2) ** 2 / n)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(v0 + z @ v))) - y
        n0 = v0 - rate * r.mean()
        new = v - rate * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v0, v = n0 + (t - 1) / s * (n0 - b0), new + (t - 1) / s * (new - b)
        b0, b, t = n0, new, s
    return b0, b


class RuleEnsemble:
    """Weighted rules and an intercept."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def expression(self, prefix: str = PREFIX) -> Column:
        """The score as a Spark column over the statistics columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, above, t in rule:
                c = F.col(f"`{prefix}{STATS[j]}`")
                test = test & ((c > F.lit(t)) if above else (c <= F.lit(t)))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(x, rule)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    share = RuleEnsemble(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    if not len(y) or y.min() == y.max():
        return share
    rng, tries, rules = np.random.default_rng(seed), np.linspace(0.02, 0.98, 33), set()
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 3000), replace=False)
        rules.update(grow(x[rows], y[rows].astype(float), w[rows], depth, tries, rng))
    kept, seen = [], set()
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        on = holds(x, rule)
        if (key := on.tobytes()) not in seen and 0 < on.sum() < len(y):
            seen.add(key)
            kept.append((rule, on))
    if not kept:
        return share
    z = np.array([on for _, on in kept], np.float64).T
    mean, scale = z.mean(axis=0), z.std(axis=0)
    b0, b = lasso((z - mean) / scale, y.astype(float), penalty)
    b = b / scale
    return RuleEnsemble(float(b0 - (b * mean).sum()), [(rule, float(c)) for (rule, _), c in zip(kept, b, strict=True) if abs(c) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """labels: the rows to learn from. At most sample_rows labelled documents, the first by hash of their ids."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(known), "id").select("id", "y", "text")
    got = with_statistics(rows).drop("text").orderBy("id").limit(2 * sample_rows).toPandas()
    return fit_rules(got[[PREFIX + s for s in STATS]].to_numpy(float), got["y"].to_numpy(int))


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score added; a column of that name gives way, all others stay."""
    docs = docs.drop(name)
    prefix = free_name(PREFIX, [*docs.columns, name])
    return with_statistics(docs, text_col, prefix).withColumn(name, model.expression(prefix)).drop(*(prefix + s for s in STATS))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    found = score(docs.withColumn("held_out", crc_mod("doc_id", 5) == 0), model).drop("text")
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a score of THRESHOLD or more."""
    model = fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    name = free_name("quality_score", docs.columns)
    return score(docs, model, name=name).where(F.col(name) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Language identification, words first: known words score by their log frequency in each language, unseen words by their
longest known character n-grams.

The model is fitted on at most `per_language` documents of each of the `max_langs` languages with the most documents, the
first by hash of their ids. It keeps `max_words` words and `max_grams` n-grams, each language having an equal share, so its
size is bounded and a large language takes nothing from a small one. Every document is scored over its whole text.

A word is a letter with the letters and combining marks that follow it. Null or letterless texts get `und` with score 0; null
languages aren't learnt from; ties between languages go to the first name; repeated rows each get their row; with nothing to
learn from, all rows get `und`; an empty table gives no rows. Columns of the table that are named as the results give way to
them in `predict`; `stage` gives back all columns as they were.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, free_name, slices, table, text_list, tidy

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDERS = (5, 4, 3, 2, 1)
UND = "und"
#: A document's evidence counts as that of so many words at most, which keeps scores off 0 and 1.
EVIDENCE = 12


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[k : k + n] for k in range(len(w) - n + 1)]


class Model:
    """Log frequencies per language; `vector` gives a word's, known or by backoff. words and grams name rows of two matrices."""

    def __init__(self, counts: dict[str, Counter], max_words: int, max_grams: int):
        self.langs = sorted(counts)
        self.words, self.grams, self.by_word, self.by_gram = {}, {}, self.logs([], []), self.logs([], [])
        if not self.langs:
            return
        found = [counts[k] for k in self.langs]
        kept = self.most(found, max_words)
        self.words, self.by_word = {w: k for k, w in enumerate(kept)}, self.logs(kept, found)
        rows = []
        for n in ORDERS:
            grams = [Counter() for _ in self.langs]
            for c, words in zip(grams, found, strict=True):
                for w, times in words.items():
                    for g in grams_of(w, n):
                        c[g] += times
            kept = self.most(grams, max_grams // len(ORDERS))
            self.grams |= {g: len(self.grams) + k for k, g in enumerate(kept)}
            rows.append(self.logs(kept, grams))
        self.by_gram = np.concatenate(rows)

    def most(self, counts: list[Counter], most: int) -> list[str]:
        """The most frequent keys of each language, an equal share of `most` each."""
        share = max(1, most // len(counts))
        return sorted({k for c in counts for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:share]})

    def logs(self, keys: list[str], counts: list[Counter]) -> np.ndarray:
        """Log of smoothed relative frequencies, less their mean over the languages: what a key says for each."""
        if not keys:
            return np.zeros((0, len(self.langs)), np.float32)
        x = np.array([[c[k] for c in counts] for k in keys], np.float64)
        sizes = np.array([max(1, sum(c.values())) for c in counts], np.float64)
        logs = np.log((x + 0.5) / (sizes + 0.5 * len(keys)))
        return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)

    def vector(self, word: str) -> np.ndarray:
        if (k := self.words.get(word)) is not None:
            return self.by_word[k]
        for n in ORDERS:
            if found := [k for k in map(self.grams.get, grams_of(word, n)) if k is not None]:
                return self.by_gram[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer(dict):
    """A worker's words with their rows in `vectors`; beyond `keep` words it starts anew."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.model, self.keep = model, keep
        self.vectors = np.zeros((1 << 14, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[k] = self.model.vector(word)
        self[word] = k
        return k

    def predict(self, text: str) -> tuple[str, float]:
        if len(self) > self.keep:
            self.clear()
        words = words_of(text) if self.model.langs else None
        if not words:
            return UND, 0.0
        n = np.fromiter(words.values(), np.float64, len(words))
        rows = [self[w] for w in words]
        z = (n @ self.vectors[rows]) * (min(EVIDENCE, n.sum()) / n.sum())
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.model.langs[k], float(p[k] / p.sum())


def first_by_hash(rows: DataFrame, k: int) -> DataFrame:
    """(id, lang): per language the k rows whose ids come first by hash, ties by id.

    A language may hold most rows, so they aren't ranked in one task: steps of a logarithmic scale of hashes are counted, and
    only rows up to the step at which k are reached are ranked, some k per language at any size of the input. The table of
    last steps has a row per language, as the model has a value per language.
    """
    hashed = rows.select("id", "lang", F.xxhash64("id").alias("hash"))
    hashed = hashed.withColumn("step", F.floor(F.log2(F.col("hash").cast("double") + F.lit(2.0**63) + 1) * 16))
    steps = hashed.groupBy("lang", "step").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy("step")) - F.col("n")
    last = steps.withColumn("before", up_to).where(F.col("before") < k).groupBy("lang").agg(F.max("step").alias("last"))
    near = hashed.join(F.broadcast(last), "lang").where(F.col("step") <= F.col("last"))
    first = Window.partitionBy("lang").orderBy("hash", "id")
    return near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= k).select("id", "lang")


def fit(docs: DataFrame, per_language: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_words: int = 60_000, max_grams: int = 100_000, max_langs: int = 256) -> Model:
    """docs: the rows to learn from. The sample is at most per_language documents a language, whole texts; of a language's
    words, as many of the most frequent are looked at as four times its share of max_words."""
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text")).where("lang is not null and text is not null and id is not null")
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang").toPandas()["lang"].tolist()
    rows = rows.where(F.col("lang").isin(langs))
    ids = first_by_hash(rows, per_language).distinct()

    def count(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            found = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[lang].update(words_of(text))
            out = [(k, w, c) for k, ws in found.items() for w, c in ws.items()]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    sample = rows.join(F.broadcast(ids), ["id", "lang"]).select("lang", "text")
    got = sample.mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in got.withColumn("k", rank).where(F.col("k") <= 4 * max_words // max(1, len(langs))).select("lang", "word", "n").toPandas().itertuples():
        counts[r.lang][r.word] = r.n
    return Model(dict(counts), max_words, max_grams)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the language and its score added; columns of those names give way, all others stay."""
    docs = docs.drop(lang_name, score_name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(held.value)
        for b in (part for whole in batches for part in slices(whole, at)):
            found = [scorer.predict(x) for x in text_list(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names, lang_name, score_name])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text", (crc_mod("doc_id", 4) == 2).alias("held_out")), model).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.4) -> DataFrame:
    """Keeps the documents whose language is recognised with a score of at least `least`."""
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    lang, score = free_name("lang_pred", docs.columns), free_name("lang_score", docs.columns)
    found = predict(docs, model, lang_name=lang, score_name=score)
    return found.where((F.col(lang) != UND) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])

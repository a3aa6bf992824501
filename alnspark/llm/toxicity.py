"""A toxicity classifier with a counterfactual penalty.

Features are hashed words and word beginnings, present or not.  Those that mark one label most are kept
and weighted by a logistic regression; for training texts with identity terms the loss also has the
squared change of the score when the terms are swapped for others of their kind, so that naming a group
moves no score.  At most ``SAMPLE`` labelled documents are used for fitting, those with the least hash of
their id; every document is scored over its whole text.

Defined cases: null and empty texts score the intercept; null ids are scored but never learned from; of
rows with one id the least text is learned from; labels that are null teach nothing; without both
labels every score is the share of label 1 (or 0).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.llm.common import slices, stored, table
from alnspark.llm.wordhash import LETTERS, Words, chunks

SAMPLE, KEPT, BITS, THRESHOLD = 12_000, 6_000, 22, 0.7
PREFIXES = (4, 5, 6, 7, 8)

#: Identity terms by kind; a swap exchanges a term for the next of its kind.
IDENTITY_TERMS = {
    "religion_en": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    "origin_en": ["african", "american", "asian", "european", "mexican", "arab"],
    "colour_en": ["black", "white", "brown"],
    "gender_en": ["man", "woman", "men", "women", "male", "female", "transgender"],
    "orientation_en": ["gay", "straight", "lesbian", "bisexual", "queer"],
    "ability_en": ["disabled", "blind", "deaf", "autistic"],
    "religion_de": ["christ", "moslem", "jude", "atheist"],
    "gender_de": ["mann", "frau", "männer", "frauen"],
    "religion_fr": ["chrétien", "musulman", "juif", "athée"],
    "gender_fr": ["homme", "femme", "hommes", "femmes"],
    "religion_es": ["cristiano", "musulmán", "judío", "ateo"],
    "gender_es": ["hombre", "mujer", "hombres", "mujeres"],
}
KINDS = {t: [k for k, kind in IDENTITY_TERMS.items() if t in kind] for kind in IDENTITY_TERMS.values() for t in kind}
_TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, KINDS), key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """``text`` with each identity term exchanged within its kind; a term of several kinds is of the language that
    the text's terms are of most often, the first of them on ties."""
    language = lambda kind: kind.rsplit("_", 1)[1]
    seen = Counter(language(kind) for t in _TERM.findall(text) for kind in KINDS[t.lower()])

    def other(match: re.Match) -> str:
        term = match[0].lower()
        kind = IDENTITY_TERMS[max(KINDS[term], key=lambda k: seen[language(k)])]
        return kind[(kind.index(term) + 1) % len(kind)]

    return _TERM.sub(other, text)


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, features) of all words and word beginnings, with repeats."""
    words = Words(texts, LETTERS, True, streams=1, prefixes=PREFIXES)
    shift = np.uint64(64 - bits)
    marks = [words.hash[0], *(words.prefix[n] for n in PREFIXES)]
    lasts = [np.arange(len(words.doc)), *(np.flatnonzero(words.prefix[n]) for n in PREFIXES)]
    return np.concatenate([words.doc[i] for i in lasts]), np.concatenate([(m[i] >> shift).astype(np.int64) for m, i in zip(marks, lasts)])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def training_set(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, marks, other) of at most ``sample`` documents: their features, and those with identity terms
    swapped, or null where there are none."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # ``sample`` rows at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(text: str) -> np.ndarray:
            return np.unique(features([text.encode()])[1]).astype(np.int32)

        for part in (part for batch in batches for part in slices(batch, 200)):
            texts = part.column("text").to_pylist()
            other = [marks(swapped(t)) if _TERM.search(t) else None for t in texts]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (list(map(marks, texts)), other)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "marks", "other"])

    return rows.mapInArrow(cut, "doc_id long, toxic int, marks array<int>, other array<int>")


def telling(rows: DataFrame, n0: int, n1: int, kept: int = KEPT) -> np.ndarray:
    """The ``kept`` features that tell most: seen often enough, and on one side."""
    seen = rows.select("toxic", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("toxic").alias("on"), F.sum(1 - F.col("toxic")).alias("off"))
    odds = F.log((F.col("on") + 0.5) / (n1 + 1)) - F.log((F.col("off") + 0.5) / (n0 + 1))
    worth = F.abs(odds) * F.sqrt(F.col("on") + F.col("off"))
    best = seen.where((F.col("on") + F.col("off") >= 3) & (F.abs(odds) >= 1)).orderBy(F.round(worth, 9).desc(), "mark").limit(kept)
    return np.sort(np.array([r["mark"] for r in best.select("mark").collect()], np.int64))


def examples(rows: DataFrame, kept: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
    """(label, places of its features among the kept, those of its swapped twin or None) of each row; ``SAMPLE`` at most."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def at(marks) -> bytes:
            return np.flatnonzero(np.isin(kept, marks, assume_unique=True)).astype(np.uint16).tobytes()

        for batch in batches:
            both = [[None if x is None else at(np.array(x, np.int64)) for x in batch.column(c).to_pylist()] for c in ("marks", "other")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array(x, pa.binary()) for x in both)], ["doc_id", "toxic", "marks", "other"])

    found = rows.mapInArrow(place, "doc_id long, toxic int, marks binary, other binary").collect()
    read = lambda x: None if x is None else np.frombuffer(bytes(x), np.uint16)
    return [(int(r["toxic"]), read(r["marks"]), read(r["other"])) for r in sorted(found, key=lambda r: r["doc_id"])]


class Model:
    """A bias and the weights of the kept features."""

    def __init__(self, bias: float, kept: np.ndarray, weights: np.ndarray):
        self.bias, self.kept, self.weights = bias, kept, weights

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, mark = features(texts)
        if len(self.kept):
            at = np.searchsorted(self.kept, mark)
            at[at == len(self.kept)] = 0
            hit = self.kept[at] == mark
            pairs = np.unique(doc[hit] * len(self.kept) + at[hit])
            total = np.bincount(pairs // len(self.kept), self.weights[pairs % len(self.kept)], len(texts))
        else:
            total = np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -50, 50)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray | None]], kept: np.ndarray, penalty: float = 4.0, ridge: float = 2e-4, steps: int = 400) -> Model:
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(0, np.int64), np.zeros(0))
    n1, n0, keep = y.sum(), len(y) - y.sum(), kept

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        return row, np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)

    pairs = [i for i, r in enumerate(rows) if r[2] is not None]
    main, twin = matrix([r[1] for r in rows]), matrix([rows[i][2] for i in pairs])
    w, b = np.zeros(len(keep)), float(np.log(n1 / n0))
    m = [np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)]
    score = lambda x, n: 1 / (1 + np.exp(-np.clip(np.bincount(x[0], w[x[1]], n) + b, -30, 30)))
    weight = np.where(y == 1, np.sqrt(n0 / n1), 1.0)
    weight /= weight.sum()
    for t in range(1, steps + 1):
        p = score(main, len(rows))
        g_main = weight * (p - y)
        if pairs:
            q = score(twin, len(pairs))
            gap = penalty * 2 * (p[pairs] - q) / len(pairs)
            g_main[pairs] += gap * p[pairs] * (1 - p[pairs])
            g_twin = -gap * q * (1 - q)
        else:
            g_twin = np.zeros(0)
        grad = np.append(np.bincount(main[1], g_main[main[0]], len(keep)) + np.bincount(twin[1], g_twin[twin[0]], len(keep)) + ridge * w, g_main.sum() + g_twin.sum())
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        step = 0.05 * m[0] / (1 - 0.9**t) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), keep, w)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.concatenate([shared.value.scores(group) for _, group in chunks(texts)]) if len(texts) else [], dtype=float)

    return docs.withColumn(out, rate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def train(docs: DataFrame, labels: DataFrame, penalty: float = 4.0) -> Model:
    """The features are chosen by Spark; the driver fits weights of ``KEPT`` features on ``SAMPLE`` rows at most."""
    rows = stored(training_set(docs, labels), "toxicity-rows")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two labels
    kept = telling(rows, n.get(0, 0), n.get(1, 0)) if len(n) > 1 else np.zeros(0, np.int64)
    return fit(examples(rows, kept), kept, penalty)


def query(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

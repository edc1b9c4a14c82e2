"""Document quality by a factorisation machine.

A text's features are its hashed words (weights of 1/sqrt(distinct words)), bins of statistics of its structure
(case, symbols, digits, repetition, word and line lengths) and bins of metadata (its length). Labels, language, source
and doc_id are never features. The machine adds to a linear score the interactions of all pairs of features, each pair
weighted by the inner product of the features' vectors, in linear time: half of the square of the sum less the sum of
the squares.

It is fitted on the driver on a bounded sample: of the labelled rows that may be learned from, ``PER_CLASS`` of each
label with the smallest hashes of their ids (all, if there are fewer); of documents that share an id, the first by text.
A row of the sample holds at most 2^17 words of 4 bytes, so it has 2 GB at the very most, and 20 MB with the usual words.
Every document is scored over its whole text.

Defined results: null text is an empty text; labels that are null or that name no document teach nothing, of rows that
repeat a label's id the largest label holds; without labels of both kinds every score is 0.5; a row without doc_id is
scored and not held out. Repeated rows stay repeated.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import carried, release, small_batches

#: Labelled rows of each class that the fit may use.
PER_CLASS = 2000
WORD_BITS = 17
FACTORS = 8
#: Batches of the fit, and rows of each.
STEPS = 400
BATCH = 64
RATE = 0.08
DECAY = 1e-5
#: Documents below this score are rejected.
THRESHOLD = 0.3
_STATS = 13
_BINS = 16
SIZE = (1 << WORD_BITS) + _STATS * _BINS
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
_STOPS = b".,;:?"


def _bin(share: float) -> int:
    return min(_BINS - 1, int(share * _BINS))


def _log_bin(x: float) -> int:
    return min(_BINS - 1, int(np.log2(1 + x)))


def features(text: str | None) -> tuple[list[int], float]:
    """Feature numbers of a text: distinct words first, then one bin of each statistic; and the words' weight."""
    raw = (text or "").encode()
    tokens = raw.split()
    n, size = len(tokens), max(1, len(raw))
    seen = Counter(tokens)
    words = sorted({zlib.crc32(t) & ((1 << WORD_BITS) - 1) for t in set(raw.lower().translate(None, _SYMBOLS + _STOPS).split())})
    lines = [x for x in raw.split(b"\n") if x]
    upper, digits = size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, _DIGITS))
    symbols, stops = size - len(raw.translate(None, _SYMBOLS)), size - len(raw.translate(None, _STOPS))
    top = seen.most_common(1)[0][1] if n else 0
    again = sum(map(eq, tokens, islice(tokens, 1, None)))
    bins = (
        _bin(upper / size),
        _bin(min(1.0, 4 * digits / size)),
        _bin(min(1.0, 4 * symbols / size)),
        _bin(min(1.0, 8 * stops / size)),
        _bin(len(seen) / n if n else 0),
        _bin(min(1.0, 3 * top / n) if n else 0),
        _bin(again / n if n else 0),
        _bin(min(1.0, sum(map(len, tokens)) / n / 20) if n else 0),
        _bin(len(set(lines)) / len(lines) if lines else 0),
        _log_bin(n / max(1, len(lines))),
        _log_bin(len(lines)),
        _log_bin(n),
        _log_bin(len(text or "")),
    )
    base = 1 << WORD_BITS
    return words + [base + k * _BINS + b for k, b in enumerate(bins)], 1 / np.sqrt(max(1, len(words)))


@dataclass
class Rows:
    """Features of several texts, one after another."""

    index: np.ndarray
    value: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[list[int], float]]) -> Rows:
        lengths = np.array([len(f) for f, _ in found], np.int64)
        index = np.concatenate([np.zeros(0, np.int64), *(np.asarray(f, np.int64) for f, _ in found)])
        value = np.where(index < 1 << WORD_BITS, np.repeat([w for _, w in found], lengths), 1 / np.sqrt(_STATS))
        return cls(index, value.astype(np.float32), np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def sums(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Linear scores with the interactions, and the factors' sums."""
        vx = self.factor[rows.index] * rows.value[:, None]
        total = np.add.reduceat(vx, rows.begin, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, rows.begin, axis=0)).sum(1)
        return self.bias + np.add.reduceat(self.weight[rows.index] * rows.value, rows.begin) + pairs, total

    def scores(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(rows)[0].astype(np.float64), -30, 30)))


def fit(found: list[tuple[np.ndarray, float]], labels: np.ndarray, seed: int = 7) -> Machine | None:
    """A machine for the labels by adaptive gradients over small batches; none if only one label occurs."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))
    share = labels.mean()
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    square_w, square_v, square_b = np.full(SIZE, 1e-4, np.float32), np.full((SIZE, FACTORS), 1e-4, np.float32), 1e-4
    order = np.concatenate([rng.permutation(len(labels)) for _ in range(1 + STEPS * BATCH // len(labels))])
    for step in range(STEPS):
        some = order[step * BATCH : (step + 1) * BATCH]
        rows = Rows.of([found[i] for i in some])
        z, total = model.sums(rows)
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * importance[some] / len(some)
        many = np.diff(np.append(rows.begin, len(rows.index)))
        each = np.repeat(slope, many).astype(np.float32) * rows.value
        pull = each[:, None] * (np.repeat(total, many, axis=0) - model.factor[rows.index] * rows.value[:, None])
        by = np.argsort(rows.index, kind="stable")
        used, begin = np.unique(rows.index[by], return_index=True)
        grad_w = np.add.reduceat(each[by], begin) + DECAY * model.weight[used]
        grad_v = np.add.reduceat(pull[by], begin, axis=0) + DECAY * model.factor[used]
        square_w[used] += grad_w**2
        square_v[used] += grad_v**2
        square_b += float(slope.sum()) ** 2
        model.weight[used] -= RATE * grad_w / np.sqrt(square_w[used])
        model.factor[used] -= RATE * grad_v / np.sqrt(square_v[used])
        model.bias -= RATE * float(slope.sum()) / np.sqrt(square_b)
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | None:
    """Fits on at most ``per_class`` labelled documents of each label, none of them held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        "doc_id is not null and quality is not null"
    )
    known = known.filter(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = None
    for label in (0, 1):
        some = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)

    @F.pandas_udf("index array<int>, value double")
    def found(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t) for t in text], columns=["index", "value"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sample.select("doc_id", "quality", found("text").alias("f")).select("doc_id", "quality", "f.*")
    rows = rows.toPandas().sort_values("doc_id")
    return fit(list(zip(rows["index"], rows["value"])), rows["quality"].to_numpy(np.float32))


def score(docs: DataFrame, model: Machine | None, text: str = "text") -> Column:
    """The score column of ``docs``; map-only. The machine is broadcast: its size is fixed."""
    small_batches(docs.sparkSession)
    if model is None:
        return F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        release()
        out = [np.zeros(0)]
        some: list = []
        for t in texts:
            some.append(features(t))
            if len(some) == 256:
                out.append(shared.value.scores(Rows.of(some)))
                some = []
        if some:
            out.append(shared.value.scores(Rows.of(some)))
        return pd.Series(np.concatenate(out))

    return scored(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted (1 from the threshold on) of every document."""
    model = train(docs, labels, per_class)
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held, score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    model = train(docs, labels, per_class)
    return docs.select(carried(docs), score(docs, model).alias("score")).filter(F.col("score") >= threshold).select("row.*")

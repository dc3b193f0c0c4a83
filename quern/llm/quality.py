"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal updates.

A text becomes a sparse vector of hashed features: words and pairs of words,
runs of one to three token shapes (case, digits, punctuation as it stands), its
length and its share of repeated words. Its value is a damped count, and the
vector has length 1. Training reads a bounded sample of labelled rows and goes
over it ``epochs`` times in one task; memory is the weight table. Scoring is a
sparse dot product per text, in Arrow batches, without a shuffle.

Nulls and limits: a null text is the empty text and is scored like any other
(by its length feature and the intercept); texts of any length are read whole;
equal texts have equal scores; an empty table gives no rows; rows with a null ``doc_id`` are
scored and never learned from; labels other than 0 and 1 are not learned from;
of repeated labels for an id the larger counts; repeated documents are each
scored; columns beyond ``doc_id`` and ``text`` are not read, whatever their
names; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import held_out, only, slices, small_batches, texts_of, training_sample
from quern.llm.textkernel import Tokens, grams, mix


@dataclass(frozen=True)
class QualityParams:
    """``train_rows`` bounds the labelled rows that are learned from."""

    bits: int = 18
    train_rows: int = 6000
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


def features(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the hashed feature numbers, ascending, and their values."""
    t = Tokens(texts)
    n = len(texts)
    word = t.kind == 1
    upper = (t.bytes >= 65) & (t.bytes <= 90)
    digit = (t.bytes >= 48) & (t.bytes <= 57)
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[np.stack([t.start, t.end])], axis=0)[0]
    size = t.end - t.start
    shape = np.where(count(upper) == 0, 1, np.where(count(upper) * 2 > size, 3, 2)) + 4 * (count(digit) > 0)
    shape = np.where(word, mix(shape.astype(np.uint64)), t.hash)
    parts = [(t.hash, t.doc), grams(t.hash, t.doc, 2), (mix(shape + np.uint64(7)), t.doc), grams(shape, t.doc, 2), grams(shape, t.doc, 3)]
    hashes = np.concatenate([mix(h + np.uint64(k)) for k, (h, _) in enumerate(parts)])
    docs = np.concatenate([d for _, d in parts])
    key = (docs.astype(np.uint64) << np.uint64(bits)) | (hashes >> np.uint64(64 - bits))
    key, counts = np.unique(key, return_counts=True)
    doc, index = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = 1 + np.log(counts)
    edges = np.searchsorted(doc, np.arange(n + 1))
    distinct = np.bincount(np.unique(t.doc.astype(np.uint64) << np.uint64(44) | t.hash >> np.uint64(20)).astype(np.int64) >> 44, minlength=n)
    total = np.diff(t.first)
    out = []
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        extra = (mix(np.array([1000 + int(total[i]).bit_length(), 2000 + int(10 * distinct[i] / max(1, total[i]))], np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        v = np.concatenate([value[a:b], [3.0, 3.0]])
        out.append((np.concatenate([index[a:b], extra]), (v / np.sqrt((v * v).sum())).astype(np.float64)))
    return out


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], p: QualityParams) -> np.ndarray:
    """Weights after one pass over ``rows``; the last one is the intercept."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for index, value, label in rows:
        at, x = np.append(index, size - 1), np.append(value, 1.0)
        w = weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
        np.add.at(z, at, g - sigma * w)
        np.add.at(n, at, g * g)
    return weights(np.arange(size)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> np.ndarray:
    """Fit on the bounded sample; returns the dense weight table (1 MB at 18 bits)."""
    spark, p = docs.sparkSession, params
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels_, order = texts_of(b), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j in slices(texts):
                got = features(texts[i:j], p.bits)
                yield pa.RecordBatch.from_arrays([pa.array(order[i:j], pa.int64()), pa.array(labels_[i:j], pa.int32()), pa.array([x.astype("<i4").tobytes() for x, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], ["ord", "label", "idx", "val"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for label, idx, val in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    yield np.frombuffer(idx, "<i4").astype(np.int64), np.frombuffer(val, "<f4").astype(np.float64), label

        yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows(), p).tobytes()], pa.binary())], ["w"])

    sample = training_sample(docs, labels, "quality", p.train_rows).select("text", "label", F.xxhash64("doc_id", F.lit(1)).alias("ord"))
    coded = sample.mapInArrow(encode, "ord long, label int, idx binary, val binary")
    passes = coded.withColumn("pass", F.explode(F.array(*map(F.lit, range(p.epochs)))))
    ordered = passes.repartition(1).sortWithinPartitions("pass", F.xxhash64("ord", "pass"), "idx").select("ord", "label", "idx", "val")
    found = ordered.mapInArrow(fit, "w binary").collect()  # one row of a fixed size
    return np.frombuffer(found[0]["w"], np.float32) if found else np.zeros((1 << p.bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, bits: int = QualityParams.bits, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for b in batches:
            texts = texts_of(b)
            out = []
            for i, j in slices(texts):
                out += [float(w[x] @ v + w[-1]) for x, v in features(texts[i:j], bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35))), pa.float64())], ["doc_id", "held_out", "score"])

    rows = only(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), threshold: float = 0.7) -> DataFrame:
    """Train on the labelled rows that may be learned from, then score every document."""
    return score(docs, train(docs, labels, params), params.bits, threshold)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Toxicity: a learned lexicon, matched through Levenshtein automata, scored in context windows.

Learning reads a bounded sample of labelled rows. It counts, per word and per
word prefix, the toxic and clean documents that hold it, and keeps the words
(matched whole, misspellings allowed) and stems (matched exactly as a prefix)
whose log-likelihood ratio stands out. Scoring runs the product of Levenshtein
automata and the lexicon trie over every token; a match weighs its term's log
odds, less per edit, and less again where it is quoted. Weights add up within a
window of tokens; a logistic model over the strongest window, the sum of all
weights and their density turns this into a probability.

Nulls and limits: a null text is the empty text, which has no matches and a score
like any other; texts of any length are scanned whole; rows with a null
``doc_id`` are scored and never learned from; labels other than 0 and 1 are not
learned from; repeated rows are each scored, equal texts alike; of terms that
stand out equally the whole word, then the longer, then the first in order comes
first; only ``doc_id`` and ``text`` are read, whatever the other columns' names,
and ``accepted`` passes all of them through; an empty table gives no rows.
Without labels of both kinds every document gets the same score.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.automaton import Automaton
from quern.llm.shared import held_out, only, slices, small_batches, stage, texts_of, training_sample


@dataclass(frozen=True)
class ToxicityParams:
    """``train_rows`` bounds the labelled rows that are learned from, and with them the lexicon."""

    train_rows: int = 8000
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7, 8)
    #: Least log odds, and least log-likelihood ratios, of a term.
    least_odds: float = 1.5
    least_ratio: float = 25.0
    least_pair_ratio: float = 15.0
    window: int = 16
    edit_discount: float = 0.6
    quote_discount: float = 0.25
    quote_tokens: int = 60


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    logistic: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])


#: Characters that open or close a quotation.
QUOTES = "\"“”„«»‹›‟"
_WORD = re.compile(r"\w+")


def counted(texts: list[str], lengths: tuple[int, ...]) -> Counter:
    """Documents per word, per proper prefix of a word ('^'), and per prefix of at least two different words ('^^')."""
    out: Counter = Counter()
    for text in texts:
        words = set(_WORD.findall(text.lower()))
        stems = Counter(w[:n] for w in words for n in lengths if len(w) > n)
        out.update(words)
        out.update("^" + s for s in stems)
        out.update("^^" + s for s, n in stems.items() if n > 1)
    return out


class Scanner:
    """Applies a lexicon to texts; the automaton grows with the tokens it meets."""

    def __init__(self, model: ToxicityModel, params: ToxicityParams):
        self.p, self.automaton = params, Automaton(model.terms)
        self.weights = np.array(model.weights or [0.0])
        self.is_word = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000, bool)
        self.quote = np.zeros(0x110000, bool)
        self.quote[[ord(c) for c in QUOTES]] = True

    def _words(self, points: np.ndarray) -> np.ndarray:
        seen = np.unique(points)
        for c in seen[~self.known[seen]]:
            self.is_word[c], self.known[c] = _WORD.match(chr(c)) is not None, True
        return self.is_word[points]

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: weight of the strongest window, of all matches, and the density of matches."""
        lower = [t.lower() for t in texts]
        points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "replace"), "<u4")
        out = np.zeros((len(texts), 3))
        if not len(points):
            return out
        word = self._words(points)
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
        term, edits = self.automaton.scan(points, start, end)
        hit = np.flatnonzero(term >= 0)
        doc = np.searchsorted(begins, start[hit], "right") - 1
        tokens = np.diff(np.searchsorted(start, begins))
        weight = self.weights[term[hit]] * self.p.edit_discount ** edits[hit]
        weight = np.where(self._quoted(points, start, hit, begins[doc]), self.p.quote_discount, 1.0) * weight
        total = np.concatenate([[0.0], np.cumsum(weight)])
        key = doc * (1 << 40) + hit  # matches of one text within the window that begins at a match
        last = np.minimum(np.searchsorted(key, key + self.p.window), np.searchsorted(doc, doc, "right"))
        np.maximum.at(out[:, 0], doc, total[last] - total[np.arange(len(hit))])
        np.add.at(out[:, 1], doc, weight)
        out[:, 2] = out[:, 1] / np.maximum(tokens, 1)
        return out

    def _quoted(self, points: np.ndarray, start: np.ndarray, hit: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether a match lies between a pair of quotation marks of one line, not too far apart."""
        if not len(hit):
            return np.zeros(0, bool)
        marks = np.flatnonzero(self.quote[points])
        lines = np.flatnonzero(points == 10)
        if not len(marks):
            return np.zeros(len(hit), bool)
        at = start[hit]
        left_line = np.where(np.searchsorted(lines, at) > 0, lines[np.maximum(np.searchsorted(lines, at) - 1, 0)], -1)
        before = np.searchsorted(marks, at) - np.searchsorted(marks, left_line)
        after = np.searchsorted(marks, at)
        close = np.where(after < len(marks), marks[np.minimum(after, len(marks) - 1)], len(points))
        line_end = lines[np.minimum(np.searchsorted(lines, at), len(lines) - 1)]
        opened = marks[np.maximum(after - 1, 0)]
        return (before % 2 == 1) & (close < line_end) & (np.searchsorted(start, close) - np.searchsorted(start, opened) <= self.p.quote_tokens)


def inputs(evidence: np.ndarray) -> np.ndarray:
    """What the logistic model sees of the evidence."""
    return np.column_stack([np.ones(len(evidence)), np.log1p(evidence[:, 0]), np.log1p(evidence[:, 1]), np.log1p(200 * evidence[:, 2])])


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, p: ToxicityParams) -> ToxicityModel:
    """Terms by falling log-likelihood ratio; a term related to a kept one by prefix is left out.

    A stem may stand out by the documents that hold it, or by those that hold
    two of its words; its weight is the log odds of one word.
    """
    odds = {text: math.log((t + 0.25) / (toxic + 0.5)) - math.log((c + 0.25) / (clean + 0.5)) for text, t, c in counts}
    rated = []
    for text, t, c in counts:
        share = (t + c) / (toxic + clean)
        terms = [(k, n) for k, n in ((t, toxic), (c, clean)) if n]
        ratio = 2 * sum((k * math.log(k / (n * share)) if k else 0) + ((n - k) * math.log((n - k) / (n * (1 - share))) if k < n and share < 1 else 0) for k, n in terms)
        if odds[text] > p.least_odds and ratio > (p.least_pair_ratio if text.startswith("^^") else p.least_ratio):
            rated.append((-round(ratio / 4), text.startswith("^"), -len(text.lstrip("^")), text))
    model, kept = ToxicityModel(), []
    for _, stem, _, text in sorted(rated):
        bare = text.lstrip("^")
        if not any(bare.startswith(k) or k.startswith(bare) for k in kept):
            kept.append(bare)
            model.terms.append((bare, stem))
            model.weights.append(odds.get("^" + bare, odds[text] / 2) if stem else odds[text])
    return model


def _fewest(toxic: int, clean: int, ratio: float) -> int:
    """The least number of toxic documents that gives a term this log-likelihood ratio, when no clean one holds it; with some it takes more."""
    total = toxic + clean
    for t in range(1, toxic + 1):
        share = t / total
        inner = t * math.log(t / (toxic * share)) + ((toxic - t) * math.log((toxic - t) / (toxic * (1 - share))) if t < toxic else 0)
        if 2 * (inner + clean * math.log(1 / (1 - share))) > ratio:
            return t
    return toxic + 1


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (mu * (1 - mu))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (mu - y) + 0.05 * w)
    return w.tolist()


def one_of_copies(sample: DataFrame) -> DataFrame:
    """One row of every label and group of copies, told by the four smallest hashes of a text's words.

    Without it the rare words of a toxic text that is copied often would all look toxic.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\W+"))
    key = F.xxhash64(F.slice(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))), 1, 4))
    keyed = sample.select("text", "label", key.alias("key"))
    return keyed.groupBy("label", "key").agg(F.min("text").alias("text")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn lexicon and logistic model from the bounded sample."""
    spark, p = docs.sparkSession, params
    small_batches(spark)
    sample = stage(spark, one_of_copies(training_sample(docs, labels, "toxic", p.train_rows).select("text", "label")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = (Counter(), Counter()), [0, 0]
        for b in batches:
            texts, y = texts_of(b), b.column(1).to_pylist()
            for k in (0, 1):
                own = [t for t, label in zip(texts, y, strict=True) if label == k]
                found[k].update(counted(own, p.stem_lengths))
                n[k] += len(own)
        found[0][""], found[1][""] = n
        keys = list(found[0] | found[1])
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([found[1][k] for k in part], pa.int64()), pa.array([found[0][k] for k in part], pa.int64())], ["term", "t", "c"])

    counts = sample.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # The empty term counts documents. Of the others those come that the odds and the count let into the lexicon; they are terms of the sample.
    counts = stage(spark, counts, "toxicity-counts")
    whole = counts.filter("term = ''").head()
    if whole is None or not whole["t"] or not whole["c"]:
        return ToxicityModel()
    odds = F.ln((F.col("t") + 0.25) / (whole["t"] + 0.5)) - F.ln((F.col("c") + 0.25) / (whole["c"] + 0.5))
    rows = [whole, *counts.filter((F.col("term") != "") & (odds > p.least_odds) & (F.col("t") >= _fewest(whole["t"], whole["c"], min(p.least_ratio, p.least_pair_ratio)))).collect()]
    # A stem that stands out by two of its words takes its weight from all documents that hold it.
    beside = {"^" + r["term"][2:] for r in rows if r["term"].startswith("^^")} - {r["term"] for r in rows}
    if beside:
        rows += counts.filter(F.col("term").isin(*sorted(beside))).collect()
    model = lexicon([(r["term"], r["t"], r["c"]) for r in rows[1:]], rows[0]["t"], rows[0]["c"], p)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model, p)
        for b in batches:
            e = np.concatenate([np.zeros((0, 3)), *(scanner.evidence(texts_of(b)[i:j]) for i, j in slices(texts_of(b)))])
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(e[:, k]) for k in range(3))], ["label", "a", "b", "c"])

    seen = sample.mapInArrow(weigh, "label int, a double, b double, c double").toPandas().sort_values(["label", "a", "b", "c"])  # train_rows rows
    model.logistic = logistic(inputs(seen[["a", "b", "c"]].to_numpy()), seen["label"].to_numpy(float))
    return model


def judging(model: ToxicityModel, params: ToxicityParams) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Builds, in a task, the function from texts to scores."""
    coded = json.dumps([model.terms, model.weights, model.logistic])

    def build() -> Callable[[list[str]], np.ndarray]:
        terms, weights, w = json.loads(coded)
        scanner = Scanner(ToxicityModel([tuple(t) for t in terms], weights), params)

        def rate(texts: list[str]) -> np.ndarray:
            e = np.concatenate([np.zeros((0, 3)), *(scanner.evidence(texts[i:j]) for i, j in slices(texts))])
            return 1 / (1 + np.exp(-np.clip(inputs(e) @ np.array(w), -35, 35)))

        return rate

    return build


def accepted(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams(), threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    judge = judging(model, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = judge()
        for b in batches:
            yield b.filter(pa.array(rate(texts_of(b)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    judge = judging(model, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = judge()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rate(texts_of(b)), pa.float64())], ["doc_id", "held_out", "score"])

    rows = only(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), threshold: float = 0.3) -> DataFrame:
    """Train on the labelled rows that may be learned from, then score every document."""
    return score(docs, train(docs, labels, params), params, threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

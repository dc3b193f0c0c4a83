"""Quality and toxicity: held-out accuracy, and the automaton against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, toxicity
from quern.llm.automaton import Automaton, allowance
from quern.llm.shared import training_sample


def auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.fixture(scope="module")
def medium():
    from pathlib import Path

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("no test data")
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize(("run", "label", "least"), [(quality.op2_quality, "quality", 0.95), (toxicity.op10_toxicity, "toxic", 0.75)], ids=["quality", "toxicity"])
def test_held_out_rows(spark, medium, run, label, least):
    """Labels of the rows that nothing was learned from, by precision and recall too, since most rows are of one kind."""
    got = run(spark, medium)
    rows = got.join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id").toPandas()
    assert got.count() == spark.read.parquet(f"{medium}/documents.parquet").count()
    held = rows[rows.held_out]
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least
    assert (held.predicted == held[label]).mean() > 0.9
    right = ((held.predicted == 1) & (held[label] == 1)).sum()
    # With some 300 labels the stems of languages with few toxic rows are not learned.
    assert right / max(1, (held.predicted == 1).sum()) > 0.9 and right / (held[label] == 1).sum() > (0.9 if label == "quality" else 0.6)
    assert ((rows.score >= 0) & (rows.score <= 1)).all()


def test_updates_equal_plain_ones():
    """The learner against updates written one coordinate at a time."""
    rng, p = np.random.default_rng(0), quality.QualityParams(bits=6)
    rows = [(np.sort(rng.choice(64, 9, replace=False)), rng.random(9), int(rng.random() < 0.5)) for _ in range(300)]
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        return 0.0 if abs(z[i]) <= p.l1 else -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)

    for index, value, y in rows:
        x = [*zip(index.tolist(), value.tolist(), strict=True), (64, 1.0)]
        w = {i: weight(i) for i, _ in x}
        mu = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x)))
        for i, v in x:
            g = (mu - y) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    got = quality.ftrl(iter(rows), p)
    assert np.allclose(got, [weight(i) for i in range(65)], atol=1e-5)


def test_copies_teach_once(spark):
    """Rare words of a toxic text that is copied often are no terms."""
    rng = random.Random(0)
    words = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    copied = " ".join(f"rare{chr(97 + k)}{chr(97 + j)}" for k in range(8) for j in range(4)) + " scoundrel"
    for k in range(900):
        bad = k % 6 == 0
        text = " ".join(rng.choice(words) for _ in range(40)) + (" scoundrel" if bad else "")
        docs.append((k, copied if k % 12 == 0 else text))
        labels.append((k, int(bad)))
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [t for t, _ in model.terms] == ["scoundrel"]


def test_held_out_rule(spark, medium):
    import zlib

    rows = quality.op2_quality(spark, medium).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify], ids=["quality", "toxicity"])
def test_odd_input(spark, odd, none, labels, classify):
    got = classify(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert classify(none, labels).count() == 0
    assert {r["score"] for r in classify(odd, labels.limit(0)).collect()} == {0.5}


def test_equal_texts_score_equally(spark, odd, labels):
    rows = [r["score"] for r in quality.classify(odd, labels).filter("doc_id in (9, 10)").collect()]
    assert len(set(np.round(rows, 12))) <= 2


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_brute_force():
    rng = random.Random(2)
    terms = [("abcab", False), ("cabba", False), ("abcabcabc", False), ("bbac", False), ("aca", True)]
    tokens = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 11))) for _ in range(4000)]
    for term, _ in terms:
        for _ in range(300):
            t = list(term)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
            tokens.append("".join(t) or "a")
    points = np.frombuffer("".join(tokens).encode("utf-32-le"), "<u4")
    end = np.cumsum([len(t) for t in tokens])
    term, edits = Automaton(terms).scan(points, end - [len(t) for t in tokens], end)
    for token, k, e in zip(tokens, term.tolist(), edits.tolist(), strict=True):
        if token.startswith("aca"):
            assert k == 4
            continue
        near = [(distance(t, token), i) for i, (t, stem) in enumerate(terms) if not stem and distance(t, token) <= allowance(t)]
        assert (k, e) == ((min(near)[1], min(near)[0]) if near else (-1, 0)), token


def test_quoted_terms_weigh_less():
    model = toxicity.ToxicityModel([("worthless", False)], [5.0])
    scanner = toxicity.Scanner(model, toxicity.ToxicityParams())
    plain, quoted, missspelt, none = scanner.evidence(["you are worthless", 'they wrote "you are worthless" there', "you are worthlss", "fine"])
    assert plain[0] > missspelt[0] > quoted[0] > none[0] == 0


def test_the_sample_is_bounded_by_rows(spark):
    """Many documents under one id are one row of the sample, whatever order they come in."""
    docs = spark.range(5000).select(F.lit(4).cast("long").alias("doc_id"), F.concat(F.lit("text "), 5000 - F.col("id")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(k, f"own text {k}") for k in range(5, 40)] + [(41, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(4, 42)] + [(4, 1)], "doc_id long, quality int")
    got = training_sample(docs, labels, "quality", 100).collect()
    assert len(got) == len({r["doc_id"] for r in got}) <= 38
    assert [tuple(r) for r in got if r["doc_id"] == 4] in ([(4, "text 1", 1)], [])
    assert training_sample(docs, labels, "quality", 3).count() <= 3

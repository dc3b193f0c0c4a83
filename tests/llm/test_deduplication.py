"""Line dedup and the n-gram Jaccard join against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quern.llm import jaccard, lines
from quern.llm.components import components


class Classes:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def of(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        self.up[self.of(y)] = self.of(x)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a == b


def brute_lines(docs, p):
    where = defaultdict(list)
    for doc_id, text in docs:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\r\f\x0b"):
                where[line].append((doc_id, pos))
    classes, index = Classes(where), defaultdict(list)
    for line in where:
        if len(line) >= p.shortest_edited:
            for key in {line} | {line[:i] + line[i + 1 :] for i in range(len(line))}:
                index[key].append(line)
    for group in index.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if one_edit(a, b):
                    classes.join(a, b)
    members = defaultdict(list)
    for line, places in where.items():
        members[classes.of(line)] += places
    gone = {x for places in members.values() for x in set(places) - {min(places)}}
    return {doc_id: None if text is None else "\n".join(x for pos, x in enumerate(text.split("\n")) if (doc_id, pos) not in gone) for doc_id, text in docs}


def crowded(rng):
    """Many lines that differ in one place only, so buckets are crowded down to single characters."""
    docs = []
    for k in range(300):
        number = rng.randrange(1000)
        docs.append((k, f"The template line number {number} is here for everyone to read\nshared tail line of some length\n{rng.choice('abcdefgh')} second template with one letter in front"))
    return [*docs, (1000, None), (1001, ""), (1002, "The template line number 7 is here for everyone to reads")]


@pytest.mark.parametrize("bucket", [1, 4, 16])
def test_lines_equal_brute_force(spark, bucket):
    docs, p = crowded(random.Random(bucket)), lines.LineParams(bucket=bucket)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), p).collect()}
    assert got == brute_lines(docs, p)


def test_lines_of_the_small_tables(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["text"] for r in lines.op1_lines(spark, small).collect()}
    assert got == brute_lines(docs, lines.LineParams())


def test_bit_parallel_distance(spark):
    rng, pairs = random.Random(1), []
    while len(pairs) < 1500:
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        if len(b) > 1:
            pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("w", lines.within_one_edit(F.col("a"), F.col("b"))).collect()
    assert [(r["a"], r["b"]) for r in rows if r["w"] != one_edit(r["a"], r["b"])] == []


def test_lines_of_odd_input(spark, odd, none):
    got = lines.dedup_lines(odd).collect()
    assert len(got) == odd.count()
    both = sorted((r["text"] for r in got if r["text"] and r["text"].startswith(("a line", "short", "other"))), key=len)
    assert both == ["other", "a line that is long enough to take part\nshort"]  # the null id comes first
    assert lines.dedup_lines(none).count() == 0


def test_names_and_short_lines(spark):
    docs = [(1, "short twin!\nabcdefghijklmnopqrstuvw\nabcd"), (2, "short twin!\nabcdefghijklmnopqrstuvx\nabce"), (3, "House\nhouse\nblouse")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k, name in enumerate(["__gone", "__id", "__th", "__hash", "__lines", "gone", "ID", "th", "hash", "lines"]):
        df = df.withColumn(name, F.lit(k))
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert [rows[k]["text"] for k in (1, 2, 3)] == ["short twin!\nabcdefghijklmnopqrstuvw\nabcd", "abce", "House\nblouse"]
    assert all(rows[k]["__lines"] == 4 and rows[k]["hash"] == 8 for k in rows)
    with pytest.raises(ValueError, match="n_lines"):
        lines.dedup_lines(df.withColumn("N_lines", F.lit(1)))


def test_rows_without_an_id_take_part(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near = text.replace("w59", "x")
    other = " ".join(f"v{k}" for k in range(30))
    docs = [(None, text), (None, text), (5, near), (None, other), (None, other), (7, " \n"), (7, " \n"), (None, ""), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__id", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("TH", F.lit(3))
    rows = jaccard.near_duplicates(df).collect()
    assert sorted((r["class_id"] or 0, r["n_copies"], r["n_links"]) for r in rows if r["class_key"] is not None) == [(0, 1, 0), (0, 1, 0), (5, 0, 1), (5, 1, 1), (5, 1, 1)]
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(5, near), (0, other), (7, " \n"), (7, " \n"), (0, ""), (0, "")])


def shingles(text):
    words = [w for w in (text or "").replace("\r", " ").split()]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(docs, threshold=0.8):
    sets = {d: shingles(t) for d, t in docs}
    reps = defaultdict(list)
    for d in sorted(sets):
        if sets[d]:
            reps[sets[d]].append(d)
    keys, holders, links = list(reps), defaultdict(list), Counter()
    for k, s in enumerate(keys):
        for g in s:
            holders[g].append(k)
    classes = Classes(range(len(keys)))
    for k, s in enumerate(keys):
        for x, n in Counter(x for g in s for x in holders[g] if x > k).items():
            if n / (len(s) + len(keys[x]) - n) >= threshold:
                links[k] += 1
                links[x] += 1
                classes.join(k, x)
    first = defaultdict(list)
    for k in range(len(keys)):
        first[classes.of(k)] += reps[keys[k]]
    out = {d: (d, 0, 0) for d in sets}
    for k in range(len(keys)):
        for d in reps[keys[k]]:
            out[d] = (min(first[classes.of(k)]), len(reps[keys[k]]) - 1, links[k])
    return out


def near_copies(rng, n=240):
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    docs = []
    for k in range(n):
        kind = k % 4
        if kind == 0:
            text = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        else:
            text = list(base) if kind < 3 else [*base, *(rng.choice(words) for _ in range(40))]
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((k, " ".join(text)))
    return [*docs, (n, docs[1][1]), (n + 1, ""), (n + 2, None)]


@pytest.mark.parametrize("chunk", [1024, 16])
def test_classes_equal_brute_force(spark, chunk):
    docs = near_copies(random.Random(3))
    p = jaccard.JaccardParams(chunk=chunk)
    got = {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), p).collect()}
    assert got == brute_classes(docs)


def test_one_of_each(spark, odd, none):
    docs = near_copies(random.Random(5))
    kept = {r["doc_id"] for r in jaccard.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {c for c, _, _ in brute_classes(docs).values()}
    got = jaccard.one_of_each(odd)
    assert got.columns == odd.columns
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect())
    assert ids.count(-1) == 2 and ids.count(9) == 2 and 10 not in ids  # two texts under id 9, the copy under 10 goes
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.one_of_each(none).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    classes = Classes({x for e in edges for x in e})
    for a, b in edges:
        classes.join(a, b)
    low = defaultdict(list)
    for x in classes.up:
        low[classes.of(x)].append(x)
    want = {x: min(low[classes.of(x)]) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want

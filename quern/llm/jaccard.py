"""N-gram Jaccard join: near duplicates by MinHash, Bayesian pruning and exact verification.

Words are runs between ASCII white space. A text is the set of its runs of five
words (a shorter text: its words as one run). Texts with equal sets form one
class, and one representative of a class goes on.

* Bands of a MinHash signature gather representatives that may be alike. Every
  band bucket is named after its smallest member, so the buckets of one group of
  copies, alike in most bands, become one gathering instead of thirty-two.
* A gathering is dealt into chunks of bounded size, and chunk pairs meet in one
  task each. No pair is ever a row.
* In a chunk pair the signatures are compared sixteen values at a time; a pair is
  dropped once the posterior probability (uniform prior) of a similarity of at
  least the threshold falls below ``tolerance``. The rest is verified exactly.
* A chunk pair returns, per representative, its number of links and the smallest
  representative it reaches; these become components.

Nulls and limits: a null text is the empty text; a text without words has no
links, and every row with one is a class of its own; rows with a null ``doc_id``
take part by their texts (a class of such rows alone has a null ``class_id``);
rows that repeat a ``doc_id`` are each judged by their own text; texts of any
length are whole; of equal texts, the smallest ``doc_id`` names the class;
nothing is capped, a gathering of any size is dealt into more chunks; columns
beyond ``doc_id`` and ``text`` are not read, whatever their names, and
``one_of_each`` passes them through; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import documents, free_names, only, slices, small_batches, stage, texts_of
from quern.llm.textkernel import SPACES, Tokens, grams, mix


@dataclass(frozen=True)
class JaccardParams:
    """32 bands of 4 values miss a pair at 0.8 once in about twenty million."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    chunk: int = 256
    chunk_shingles: int = 1 << 20

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text, and where each text's begin (with the end)."""
    t = Tokens(texts, SPACES)
    count = np.diff(t.first)
    hashes, docs = grams(t.hash, t.doc, n)
    short = np.flatnonzero((count > 0) & (count < n))
    for k in range(1, n):  # all the words of a text with k words, as one run
        some = short[count[short] == k]
        out = t.hash[t.first[some]]
        for j in range(1, k):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + t.hash[t.first[some] + j] + np.uint64(j))
        hashes, docs = np.concatenate([hashes, mix(out + np.uint64(k))]), np.concatenate([docs, some])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1]))[: len(hashes)]
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(texts) + 1))


def _factors(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(hashes: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (texts x size); texts without shingles get zeros."""
    out = np.zeros((len(edges) - 1, size), np.uint32)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        begin = edges[:-1][full]
        for k, factor in enumerate(_factors(size)):
            x = hashes * factor
            out[full, k] = np.minimum.reduceat(((x ^ (x >> np.uint64(29))) * factor) >> np.uint64(32), begin)
    return out


def set_keys(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; equal sets have equal keys."""
    out = np.zeros((2, len(edges) - 1), np.uint64)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        out[0, full] = np.add.reduceat(mix(hashes), edges[:-1][full])
        out[1, full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), edges[:-1][full])
    return out[0], out[1]


def fewest_matches(p: JaccardParams) -> dict[int, int]:
    """By values compared, the matches below which the posterior of reaching the threshold is under the tolerance.

    With a uniform prior P(J >= t | m of n) is the chance that a binomial with
    n + 1 trials and probability t is at most m.
    """
    out = {}
    for n in range(p.step, p.size + 1, p.step):
        total, m = 0.0, 0
        while total < p.tolerance:
            total += math.comb(n + 1, m) * p.threshold**m * (1 - p.threshold) ** (n + 1 - m)
            m += 1
        out[n] = m - 1
    return out


def candidates(a: np.ndarray, b: np.ndarray, same: bool, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature tables that Bayesian pruning leaves."""
    least = fewest_matches(p)
    i, j, matches = [], [], []
    for x in range(0, len(a), 256):  # the first values, for a block of rows against all
        m = np.zeros((len(a[x : x + 256]), len(b)), np.int16)
        for k in range(p.step):
            m += a[x : x + 256, k, None] == b[None, :, k]
        r, c = np.nonzero(m >= least[p.step])
        if same:
            r, c = r[r + x < c], c[r + x < c]
        i.append(r + x)
        j.append(c)
        matches.append(m[r, c])
    i, j, matches = np.concatenate(i), np.concatenate(j), np.concatenate(matches).astype(np.int64)
    for n in range(2 * p.step, p.size + 1, p.step):
        for x in range(0, len(i), 1 << 18):
            s = slice(x, x + (1 << 18))
            matches[s] += (a[i[s], n - p.step : n] == b[j[s], n - p.step : n]).sum(1)
        keep = matches >= least[n]
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def overlaps(i: np.ndarray, j: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[j]."""
    if len(i) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # Many pairs among few sets: count through an incidence matrix, in slabs of columns. Hashes of one set count nowhere.
    values, where = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    shared = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[where]
    row, column = row[keep], column[where[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    for x in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [x, x + width])
        dense = np.zeros((len(a) + len(b), width), np.float32)
        dense[row[lo:hi], column[lo:hi] - x] = 1
        total += dense[: len(a)] @ dense[len(a) :].T
    return total[i, j].astype(np.int64)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def chunk_links(rows: list[dict], hub: int, a_chunk: int, b_chunk: int, p: JaccardParams) -> tuple[list[int], list[int], list[int]]:
    """Of one chunk pair: representatives with links, their links, the smallest one they reach."""
    rows = sorted({r["rep"]: r for r in rows}.values(), key=lambda r: r["rep"])
    a = [r for r in rows if r["part"] == a_chunk]
    b = a if a_chunk == b_chunk else [r for r in rows if r["part"] == b_chunk]
    if not a or not b:
        return [], [], []
    sig = lambda part: np.frombuffer(b"".join(r["sig"] for r in part), "<u4").reshape(len(part), p.size)
    i, j = candidates(sig(a), sig(b), a is b, p)
    sets_a = [np.frombuffer(r["shingles"], "<u8") for r in a]
    sets_b = sets_a if a is b else [np.frombuffer(r["shingles"], "<u8") for r in b]
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    both = overlaps(i, j, sets_a, sets_b)
    union = size_a[i] + size_b[j] - both
    good = both >= p.threshold * union - 1e-9
    i, j = i[good], j[good]
    # A pair that meets in several gatherings counts in the one with the smallest name.
    hubs_a = [r["hubs"] for r in a]
    hubs_b = hubs_a if a is b else [r["hubs"] for r in b]
    first = np.array([min(hubs_a[x] & hubs_b[y]) == hub for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
    i, j = i[first], j[first]
    ids = np.array([r["rep"] for r in a] + ([] if a is b else [r["rep"] for r in b]))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    x, y = place[i], place[j + (0 if a is b else len(a))]
    links = np.bincount(np.concatenate([x, y]), minlength=len(ids))
    reach = roots(len(ids), x, y)
    some = np.flatnonzero(links)
    ids = ids[order]
    return ids[some].tolist(), links[some].tolist(), ids[reach[some]].tolist()


def near_duplicates(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, th (hash of the text), class_key (null without words), class_id (smallest doc_id of the class), n_copies (other rows with an equal set), n_links (other sets at or above the threshold)."""
    spark, p = docs.sparkSession, params
    small_batches(spark)
    rows = only(docs, doc_id="long", text="string").select("doc_id", "text", F.xxhash64("text").alias("th"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            for i, j in slices(texts):
                hashes, edges = shingle_sets(texts[i:j], p.words)
                k1, k2 = set_keys(hashes, edges)
                sig = signatures(hashes, edges, p.size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(edges), pa.int64()), pa.array([s.astype("<u4").tobytes() for s in sig], pa.binary())], ["doc_id", "th", "k1", "k2", "n", "sig"])

    signed = stage(spark, rows.mapInArrow(sign, "doc_id long, th long, k1 long, k2 long, n long, sig binary"), "jaccard-signed")
    reps = signed.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.min("th").alias("th"), F.count("*").alias("rows"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    reps = stage(spark, reps, "jaccard-reps")

    # A set goes by its key from here on: one doc_id may stand before several texts.
    bands = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * (4 * p.rows) + 1, F.lit(4 * p.rows))))
    postings = reps.select(F.col("k1").alias("rep"), "doc", "th", "n", F.explode(bands).alias("band"))
    shared = postings.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("band", "hub")
    shared = stage(spark, shared, "jaccard-buckets")
    members = stage(spark, postings.join(shared, "band").groupBy("hub", "rep").agg(F.max("n").alias("n"), F.min("doc").alias("doc"), F.min("th").alias("th")), "jaccard-members")
    sizes = members.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    sizes = stage(spark, sizes.select("hub", F.greatest(F.ceil(F.col("m") / p.chunk), F.ceil(F.col("s") / p.chunk_shingles)).cast("int").alias("parts")), "jaccard-sizes")
    gathered = members.join(sizes, "hub").groupBy("rep").agg(F.min("doc").alias("doc"), F.min("th").alias("th"), F.collect_list(F.struct("hub", "parts")).alias("hubs"))  # at most one per band

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            for i, j in slices(texts):
                hashes, edges = shingle_sets(texts[i:j], p.words)
                sig = signatures(hashes, edges, p.size)
                out = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([s.astype("<u4").tobytes() for s in sig], pa.binary()), pa.array([hashes[edges[k] : edges[k + 1]].astype("<u8").tobytes() for k in range(j - i)], pa.binary())], ["rep", "hubs", "sig", "shingles"])
                # Other texts under the same doc_id are not meant.
                yield out.filter(pa.array(set_keys(hashes, edges)[0].view(np.int64) == out.column(0).to_numpy()))

    known = rows.filter("doc_id is not null").select(F.col("doc_id").alias("doc"), "text")
    texts = known.join(gathered.drop("th"), "doc").select("rep", "text", "hubs")
    # A set that only rows without an id hold is found by the hash of one of its texts.
    nameless = rows.filter("doc_id is null").select("th", "text").join(gathered.filter("doc is null").drop("doc"), "th").dropDuplicates(["rep"])
    texts = texts.unionByName(nameless.select("rep", "text", "hubs"))
    sets = texts.mapInArrow(expand, "rep long, hubs array<struct<hub:long,parts:int>>, sig binary, shingles binary")
    part = F.pmod(F.xxhash64("rep"), F.col("h.parts")).cast("int")
    dealt = sets.withColumn("h", F.explode("hubs")).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("h.parts") - 1)))
    dealt = dealt.select(F.col("h.hub").alias("hub"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", F.col("hubs.hub").alias("hubs"), "sig", "shingles")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, held: list[dict]) -> pa.RecordBatch:
            got = chunk_links(held, *key, p)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["rep", "links", "root"])

        key, held = None, []
        for b in batches:
            for r in b.to_pylist():
                r["hubs"] = set(r["hubs"])
                if (k := (r["hub"], r["i"], r["j"])) != key:
                    if len(held) > 1:
                        yield out(key, held)
                    key, held = k, []
                held.append(r)
        if len(held) > 1:
            yield out(key, held)

    cells = dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "rep")
    linked = stage(spark, cells.mapInArrow(link, "rep long, links long, root long"), "jaccard-links")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("n_links"))
    labels = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sets = reps.select("k1", "k2", "doc", "rows")
    found = sets.join(counts.withColumnRenamed("rep", "k1"), "k1").join(labels.withColumnRenamed("node", "k1"), "k1", "left").withColumn("key", F.coalesce("label", "k1"))
    first = found.groupBy("key").agg(F.min("doc").alias("class_id"))
    linked_sets = found.join(first, "key").select("k1", "k2", "key", "class_id", "rows", "n_links")
    copied = sets.filter("rows > 1").join(counts.withColumnRenamed("rep", "k1"), "k1", "left_anti").select("k1", "k2", F.col("k1").alias("key"), F.col("doc").alias("class_id"), "rows", F.lit(0).cast("long").alias("n_links"))
    classes = stage(spark, linked_sets.union(copied), "jaccard-classes")
    result = signed.select("doc_id", "th", "k1", "k2", "n").join(classes, ["k1", "k2"], "left")
    return result.select("doc_id", "th", F.when(F.col("n") > 0, F.coalesce("key", "k1")).alias("class_key"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("rows", F.lit(1)) - 1).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: A text without words: nothing but ASCII white space.
WORDLESS = r"^[ \t\n\r\f\x0b]*$"


def one_of_each(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """One row of every class, with all its columns: that of the smallest ``doc_id`` (of several texts under it, one); rows without words all stay."""
    spark = docs.sparkSession
    found = near_duplicates(docs, params).filter("class_key is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("first")
    id_, th, own = free_names(docs.columns, "id", "th", "hash")
    first = found.groupBy("class_key").agg(best).select(F.col("first.doc_id").alias(id_), F.col("first.th").alias(th))
    first = stage(spark, first, "jaccard-first")
    wordless = F.coalesce(F.col("text").rlike(WORDLESS), F.lit(True))
    hashed = docs.filter(~wordless).withColumn(own, F.xxhash64("text"))
    kept = hashed.join(first, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(th))).dropDuplicates([id_, th])
    return kept.drop(id_, th, own).unionByName(docs.filter(wordless))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("th", "class_key")

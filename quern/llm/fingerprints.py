"""Document fingerprints: consistent weighted sampling, in DataFrame functions only.

A text is the multiset of its runs of five words (words lie between ASCII white
space; a shorter text: its words as one run), a run's count being its weight.
Every run draws, for each of the ``bins`` samples anew, r and c from Gamma(2, 1)
and b uniform, all from hashes of run and sample; with weight w it takes the
quantised level t = floor(ln w / r + b) and the value a = c exp(r (b - t - 1)).
A sample keeps the run and level of its smallest value. Whether two texts agree
in a sample has the probability of their generalised Jaccard similarity, so the
share of agreeing samples estimates it.

A sample's entry is one integer, the value above a part of the hash of run and
level, so a sample's smallest value is a plain minimum, and a text's fingerprint
one grouped aggregate over its runs, eight samples a row. With the uniform draws
r = -ln(u1 u2) and c = -ln(u3 u4), so that

    a >= (1 - u3 u4) (u1 u2)^(1 - b) for w = 1,   a >= (1 - u3 u4) u1 u2 / w else.

One hash gives the leading bits of all five draws and with them a lower bound of
this; where it lies above ``reach`` / W (W being the text's sum of weights) the
draw is left there. The others take their further bits from a second hash, and
the logarithms, and count if their value lies below ``reach`` / W. A sample has no
such value once in e**reach times (5e8 at 20); it is then open, and the texts with
open samples are drawn again without any bound. So fingerprints are those of all
draws, whatever the bound.

Nulls and limits: a null text is the empty text, whose fingerprint is empty;
two empty fingerprints are alike (1.0), an empty and a filled one are not (0.0);
``n_chars`` counts code points; the order of documents is ascending ``doc_id``,
nulls first, ties by a hash of the text; repeated rows follow one another; the
document after the last is the first, which may be the document itself;
texts of any length are whole; columns beyond ``doc_id`` and ``text`` are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import documents, only, stage


@dataclass(frozen=True)
class FingerprintParams:
    words: int = 5
    #: Samples; a multiple of eight.
    bins: int = 64
    #: Draws above this over a text's sum of weights are left at first; a text that loses a sample by it is drawn again without.
    reach: float = 20.0
    #: Ids are cut at their quantiles into this many ranges at most, and ranges into blocks of about ``block`` documents.
    ranges: int = 2048
    block: int = 256


#: Leading bits of a uniform draw, its further bits, and the same for b.
_LEAD, _MORE, _LEAD_B, _MORE_B = 15, 13, 4, 12
#: What an open sample holds: none of its draws lies below the bound.
NONE = (1 << 63) - 1
_EMPTY = "array<bigint>"


def _part(bits: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, shift).bitwiseAND((1 << width) - 1)


def _draws(runs: DataFrame, samples: Column, *keep: str) -> DataFrame:
    """``keep``, sample and entry of the draws of ``runs`` that may be a sample's smallest."""
    each = runs.select("*", F.explode_outer(samples).alias("sample")).withColumn("h", F.xxhash64("run", "sample"))
    h = F.col("h")
    lead = [_part(h, _LEAD * k, _LEAD) for k in range(4)]
    b4 = _part(h, 4 * _LEAD, _LEAD_B)
    unit = 1 << 2 * _LEAD
    low, rest = lead[0] * lead[1], unit - (lead[2] + 1) * (lead[3] + 1)  # of u1 u2 and of 1 - u3 u4, from below, in units
    # In whole numbers, as this is what most draws cost: by the exponent 1, and where b is a half at least (the first bit) by 1/2, squared.
    half = F.shiftright(rest, _LEAD)
    may = (low * rest <= F.col("most")) & ((h >= 0) | (half * half * low <= F.col("most2")))
    # A weight below 0 says that the run is a number to be carried, in the place of the sample that it names.
    carried = (F.col("weight") < 0) & (F.col("sample") == -F.col("weight") - 1)
    left = each.filter(may | carried).withColumn("more", F.xxhash64("run", "h"))
    more = F.col("more")
    u = [((lead[k] * (1 << _MORE) + _part(more, _MORE * k, _MORE)).cast("double") + 0.5) * (1.0 / (1 << (_LEAD + _MORE))) for k in range(4)]
    b = ((b4 * (1 << _MORE_B) + _part(more, 4 * _MORE, _MORE_B)).cast("double") + 0.5) * (1.0 / (1 << (_LEAD_B + _MORE_B)))
    left = left.withColumn("r", -F.ln(u[0] * u[1])).withColumn("c", -F.ln(u[2] * u[3])).withColumn("b", b)
    left = left.withColumn("level", F.expr("if(weight = 1D, 0L, floor(log_weight / r + b))"))  # the plain "if" makes shorter code than "case"
    a = F.col("c") * F.exp(F.col("r") * (F.col("b") - F.col("level") - 1))
    value = F.floor((1 - 1 / (a + 1)) * float(1 << 38))
    who = F.xxhash64("run", "level").bitwiseAND((1 << 24) - 1)
    left = left.withColumn("drawn", F.when(a <= F.col("limit"), F.shiftleft(value, 24) + who).otherwise(NONE))
    return left.select(*keep, "sample", F.expr("if(weight < 0D, run, drawn)").alias("entry"))


def _runs(df: DataFrame, text: str, key: list[str], p: FingerprintParams, carry: Column | None = None) -> DataFrame:
    """``key``, run, weight, limit (reach / W), log_weight, and the bounds most (limit times weight in 60 bits) and most2 (its square for weight 1): a row per distinct run of ``text``."""
    blank = "\' \t\n\r\f\x0b\'"
    bare = F.expr(f"trim(BOTH {blank} FROM `{text}`)")
    carry = F.lit(None).cast(_EMPTY) if carry is None else carry
    df = df.select(*key, bare.alias("bare"), carry.alias("carry")).filter("bare <> '' or carry is not null").select(*key, "carry", F.split("bare", "[ \\t\\n\\r\\f\\x0b]+").alias("words"))
    n = F.size("words")
    at = lambda i, k: F.get(F.col("words"), i + k)
    whole = F.transform(F.slice("words", F.lit(1), F.greatest(n - (p.words - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(at(i, k) for k in range(1, p.words))))
    short = F.array(F.xxhash64(F.array_join("words", " "), F.lit(p.words)))
    df = df.select(*key, "carry", F.when(F.col("carry").isNotNull(), F.col("carry")).when(n >= p.words, whole).otherwise(short).alias("runs"))
    df = df.withColumn("distinct", F.array_distinct("runs"))
    # Where runs repeat: sorted, with the position at which each begins; the next one less this one is its count.
    df = df.withColumn("sorted", F.when((F.size("distinct") < F.size("runs")) & F.col("carry").isNull(), F.sort_array("runs")))
    df = df.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda i: (i == 0) | (F.get(F.col("sorted"), i) != F.get(F.col("sorted"), i - 1))))
    counts = F.transform("begins", lambda at_, i: F.coalesce(F.get(F.col("begins"), i + 1), F.size("sorted")) - at_)
    df = df.withColumn("weights", F.when(F.col("carry").isNotNull(), F.transform("carry", lambda x, i: -1 - i)).otherwise(counts))
    # The outer form: for the other one the optimiser would make the runs twice, to see that there are some.
    df = df.select(*key, (p.reach / F.size("runs")).alias("limit"), "weights", F.posexplode_outer(F.when(F.col("sorted").isNull(), F.col("runs")).otherwise(F.sort_array("distinct"))).alias("at", "run"))
    zero = lambda c, v: F.coalesce(c, F.lit(v))  # noqa: E731  (never null; says so to the compiler)
    df = df.select(*key, zero(F.col("run"), 0).alias("run"), zero(F.get("weights", F.col("at")), 1).cast("double").alias("weight"), zero(F.col("limit"), 0.0).alias("limit"))
    log = F.when(F.col("weight") <= 1.0, 0.0).otherwise(zero(F.ln("weight"), 0.0))
    limit = F.col("limit")
    most = F.least(limit * F.col("weight"), F.lit(1.0)) * float(1 << 60)
    most = F.when(F.col("weight") < 0, F.lit(-1).cast("long")).otherwise(most.cast("long") + 1)  # a carried number is no draw
    squared = F.when(F.col("weight") == 1.0, F.least(limit * limit, F.lit(1.0))).otherwise(1.0) * float(1 << 60)
    return df.select(*key, "run", "weight", "limit", log.alias("log_weight"), most.alias("most"), (squared.cast("long") + 1).alias("most2"))


def prints(df: DataFrame, text: str, key: list[str], out: str, p: FingerprintParams, group: list[str] | None = None, carry: Column | None = None) -> DataFrame:
    """``key`` and ``out``, the entries of the samples of ``text`` in order, open ones too; no row for a text without words. Rows equal in ``key`` have one text.

    With ``group``, a part of ``key``, one row per group: ``out`` is an array of the
    rest of the key (one column) and the entries. Where ``df`` lies partitioned by
    columns of the key, no row moves. A row of ``df`` with ``carry`` (array of at
    most eight integers) has these as its first entries.
    """
    group = key if group is None else group
    rest = [c for c in key if c not in group]
    # Eight samples a row: an aggregate of all at once is more code than the JVM compiles.
    smallest = [F.min(F.expr(f"if(sample & 7 = {k}, entry, {NONE}L)")).alias(f"s{k}") for k in range(8)]
    found = _draws(_runs(df, text, key, p, carry), F.array(*(F.lit(k) for k in range(p.bins))), *key).groupBy(*key, F.shiftright("sample", 3).alias("eight")).agg(*smallest)
    eights = F.collect_list(F.struct(*rest, "eight", F.array(*(f"s{k}" for k in range(8))).alias("s"))).alias("e")
    found = found.groupBy(*group).agg(eights)
    # Eight samples all of whose draws are left have no row; they are open.
    def whole(entries: Column) -> Column:
        row = lambda k: F.coalesce(F.get(F.filter(entries, lambda x: x["eight"] == k), F.lit(0))["s"], F.array(*[F.lit(NONE)] * 8))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(p.bins // 8 - 1)), row))

    if not rest:
        return found.select(*group, whole(F.col("e")).alias(out))
    names = F.array_distinct(F.transform("e", lambda x: x[rest[0]]))
    return found.select(*group, F.transform(names, lambda n: F.struct(n.alias(rest[0]), whole(F.filter("e", lambda x: x[rest[0]] == n)).alias("entries"))).alias(out))


def unbounded(p: FingerprintParams) -> FingerprintParams:
    return replace(p, reach=math.inf)


def is_open(fingerprint: Column) -> Column:
    """True where a sample is open."""
    return F.array_contains(fingerprint, F.lit(NONE))


def with_fingerprint(df: DataFrame, out: str, p: FingerprintParams) -> DataFrame:
    """doc_id, text and ``out``: entries of the samples of ``text``; texts meet theirs by two hashes. ``df`` has doc_id and text alone."""
    df = df.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), F.col("text")))
    texts = df.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    found = stage(df.sparkSession, prints(texts, "text", ["k1", "k2"], out, p), "fingerprints-first")
    lost = found.filter(is_open(F.col(out))).select("k1", "k2")
    if not lost.isEmpty():
        again = prints(texts.join(lost, ["k1", "k2"], "left_semi"), "text", ["k1", "k2"], out, unbounded(p))
        found = found.filter(~is_open(F.col(out))).unionByName(again)
    return df.join(found, ["k1", "k2"], "left").select("doc_id", "text", F.coalesce(out, F.array().cast(_EMPTY)).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing samples; two empty fingerprints are alike, an empty and a filled one are not."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(same / F.greatest(F.size(a), F.size(b)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda k: F.lower(F.hex(k))), ".")


def _cuts(df: DataFrame, p: FingerprintParams) -> tuple[list[float], list[float]]:
    """Where the ranges of ids begin, and how wide a block is in each: quantiles, so that ids may be sparse, clustered or hashed."""
    n = df.filter("doc_id is not null").count()
    count = max(1, min(p.ranges, math.ceil(n / (16 * p.block))))
    at = F.percentile_approx("doc_id", F.array(*(F.lit(k / count) for k in range(count + 1))), 20 * count)
    found = df.agg(at.alias("at")).head()["at"] or [0]
    begins = sorted({float(x) for x in found[:-1]} or {float(found[0])})
    ends = [*begins[1:], float(found[-1]) + 1]
    blocks = max(1.0, n / count / p.block)
    return begins, [max(1.0, (b - a) / blocks) for a, b in zip(begins, ends, strict=True)]


def _place(df: DataFrame, p: FingerprintParams) -> DataFrame:
    """``df`` with g (range of its id, 0 for none), block and tie. Both only rise with the id; null ids are dealt by their text's hash."""
    begins, widths = _cuts(df, p)
    array = lambda values: F.array(*map(F.lit, values))
    at = F.col("doc_id").cast("double")
    # Halving the list of ranges: as many steps as its length has bits.
    steps = array([1 << k for k in reversed(range(len(begins).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step < len(begins)) & (F.get(array(begins), low + step) <= at), low + step).otherwise(low)) if len(begins) > 1 else F.lit(0)
    df = df.withColumn("tie", F.xxhash64("text")).withColumn("g", F.when(F.col("doc_id").isNull(), 0).otherwise(found + 1))
    inside = F.floor((at - F.get(array(begins), F.col("g") - 1)) / F.get(array(widths), F.col("g") - 1))
    return df.withColumn("block", F.when(F.col("g") == 0, F.pmod(F.col("tie"), F.lit(4096))).otherwise(inside))


def with_next(df: DataFrame, p: FingerprintParams) -> DataFrame:
    """doc_id, text, ``next`` (struct of both of the document after it), and the row's place (g, block, copy, spot); ``df`` has doc_id and text alone.

    Documents are dealt into blocks of neighbouring ids. The first document of a
    block is copied behind the last of the block before it, so every successor
    lies within a block, and no window spans the table: blocks are put in order
    within their range of ids, and the ranges, a bounded number, among themselves.
    The copies are rows too, with ``copy`` true and no successor. Rows lie
    partitioned by g and block.
    """
    placed = _place(df, p)
    heads = placed.groupBy("g", "block").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    heads = stage(df.sparkSession, heads, "fingerprints-heads")
    inner = Window.partitionBy("g").orderBy("block")
    ranges = heads.groupBy("g").agg(F.max("block").alias("block"))
    order = Window.orderBy("g")  # at most ``ranges`` + 1 rows
    around = ranges.withColumn("before", F.lag(F.struct("g", "block")).over(order)).withColumn("end", F.last(F.struct("g", "block")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    around = around.select("g", F.coalesce("before", "end").alias("outer"))
    linked = heads.withColumn("own", F.lag(F.struct("g", "block")).over(inner)).join(around, "g")
    linked = linked.select(F.col("head.doc_id").alias("id_"), F.col("head.tie").alias("tie_"), F.coalesce("own", "outer").alias("to_"))
    # Written first, so the plan knows its size, and the texts are dealt once where it is small.
    linked = stage(df.sparkSession, linked, "fingerprints-links")
    joined = placed.join(linked, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tie") == F.col("tie_")), "left")
    # Rows equal in id and text are heads together; the copy behind the block before serves for all of them.
    copies = F.array(F.struct("g", "block", F.lit(False).alias("copy")), F.struct(F.col("to_.g").alias("g"), F.col("to_.block").alias("block"), F.lit(True).alias("copy")))
    spread = joined.withColumn("at_", F.explode(F.when(F.col("to_").isNull(), F.slice(copies, 1, 1)).otherwise(copies)))
    dealt = spread.select(F.col("at_.g").alias("g"), F.col("at_.block").alias("block"), F.col("at_.copy").alias("copy"), "doc_id", "tie", "text")
    window = Window.partitionBy("g", "block").orderBy("copy", "doc_id", "tie")
    return dealt.select("g", "block", "copy", F.row_number().over(window).alias("spot"), "doc_id", "text", F.lead(F.struct("doc_id", "text")).over(window).alias("next"))


def fingerprints(docs: DataFrame, params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """doc_id, text, fingerprint: array of ``bins`` integers, empty for a text without words."""
    rows = only(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_fingerprint(rows, "fingerprint", params)


def _beside_edits(rows: DataFrame, p: FingerprintParams) -> DataFrame:
    """Places, the values told, and the fingerprints f0 of the text, f1 of its edited text and f2 of the next document, of the documents of ``rows``."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("copy"), F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)))
    rows = rows.withColumn("edited", edited)
    place = ["g", "block", "spot"]
    # From the dealing on no text moves: own and edited texts are drawn where they lie, and the row's other values go with the draws as integers.
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    quarter = lambda k: F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long")
    flags = F.col("copy").cast("long") + 2 * F.col("doc_id").isNull().cast("long")
    told = F.array(F.coalesce("doc_id", F.lit(0)), n.cast("long"), flags, *(F.coalesce(quarter(k), F.lit(0)) for k in range(4)))
    none = F.lit(None).cast(_EMPTY)
    each = F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("t"), c.alias("c")) for k, t, c in ((0, F.col("text"), none), (1, F.col("edited"), none), (2, F.lit(""), told))))
    texts = rows.select(*place, F.explode(each).alias("e")).select(*place, "e.kind", "e.t", "e.c")
    found = prints(texts, "t", [*place, "kind"], "f", p, place, F.col("c"))
    of_kind = lambda k: F.coalesce(F.get(F.filter("f", lambda x: x["kind"] == k), F.lit(0))["entries"], F.array().cast(_EMPTY))
    found = found.select(*place, of_kind(0).alias("f0"), of_kind(1).alias("f1"), F.slice(of_kind(2), 1, 7).alias("v"))
    return found.withColumn("f2", F.lead("f0").over(Window.partitionBy("g", "block").orderBy("spot"))).filter(F.get("v", F.lit(2)).bitwiseAND(1) == 0)


def edits(docs: DataFrame, p: FingerprintParams = FingerprintParams()) -> DataFrame:
    """Every document beside its edited text and the next document; the rows of ``op9_fingerprints``.

    The first draws are written; blocks of documents that hold an open sample are
    drawn again without a bound.
    """
    spark = docs.sparkSession
    docs = only(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, p)
    lost = is_open(F.col("f0")) | is_open(F.col("f1")) | is_open(F.col("f2"))
    near = [likeness(F.col("f0"), F.col(other)).alias(name) for other, name in (("f1", "near_edited"), ("f2", "near_next"))]
    kept = ["g", "block", "v", "f0", "f1", *near]
    first = stage(spark, _beside_edits(rows, p).select(*kept, F.coalesce(lost, F.lit(False)).alias("lost")), "fingerprints-first")
    done = first.drop("lost")
    blocks = first.filter("lost").select("g", "block").distinct()
    if not blocks.isEmpty():
        again = _beside_edits(rows.join(blocks, ["g", "block"], "left_semi"), unbounded(p)).select(*kept)
        done = done.join(blocks, ["g", "block"], "left_anti").unionByName(again)
    value = lambda k: F.get("v", F.lit(k))
    return done.select(
        F.when(value(2) == 0, value(0)).alias("doc_id"),
        value(1).alias("n_chars"),
        F.concat(*(F.lpad(F.lower(F.hex(value(3 + k))), 16, "0") for k in range(4))).alias("edited_sha256"),
        as_text(F.col("f0")).alias("fingerprint"),
        as_text(F.col("f1")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(documents(spark, sf_dir))

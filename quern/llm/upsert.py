"""Copy-on-write keyed upsert: changes go into a folder of sorted Parquet files by rewriting only the files that they alter.

A key's home is the last file that begins at or below it, else the first file.
Of a key's changes the latest counts; a combining aggregate finds it, so that a
key with a third of all changes sends one row per task on. The rows of touched
files and the latest changes are then keyed (home, id, tag, seq, change_id) and
go through ``repartitionAndSortWithinPartitions``. Its partitioner cuts at
quantiles of the ids, not at files: many inserts into one home are many tasks'
work. A generator folds each id's replay, holding one change at a time, and
spools the rows that come out of it as a written table in the shared folder, so
a lost executor costs a re-read. How many rows each home has, one number per home
and task, decides where balanced files are cut; every file is then written by one task.

Only what the caller bounds comes to the driver: a row per starting file (first
and last key) and per pair of home and task. Rows never do.

New files are written to a hidden folder inside first; then the replaced files
are deleted and the new ones moved in. A run that dies before that leaves the
folder as it was.

Nulls and limits: rows and changes without a key take no part; null ``seq`` and
``change_id`` come first; changes that tie in both are told apart by their other
values; rows that share a key are all changed or deleted, also where they lie in
two files; null and NaN values equal themselves; texts of any length are whole;
further columns stay, whatever their names; without starting files there is no
home and nothing is applied; a folder of which nothing is left has no data files.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import free_names, ship, small_batches, stage, staging
from quern.session import shared_dir

IGNORE, DELETE, SET = "ignore", "delete", "set"
_LEAST = -(2**63)


def _plain(df: DataFrame) -> DataFrame:
    """Times with a zone as microseconds: Python would read them in the worker's zone."""
    return df.select(*(F.unix_micros(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema))


def _plain_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema])


def _as(df: DataFrame, schema: T.StructType, row: str = "row") -> DataFrame:
    """The columns of ``schema`` out of a struct of plain ones."""
    at = lambda f: F.col(row)[f.name]
    return df.select(*((F.timestamp_micros(at(f)) if isinstance(f.dataType, T.TimestampType) else at(f)).alias(f.name) for f in schema))


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _write_files(spark: SparkSession, keyed, files: int, schema: T.StructType, path: str) -> None:
    """Rows keyed by (file, place) as one Parquet file for each of ``files`` numbers, each by one task, streaming."""
    if not files:
        fs, where = _fs(spark, path)
        fs.mkdirs(where)
        return
    dealt = keyed.repartitionAndSortWithinPartitions(files, lambda k: k[0])
    rows = spark.createDataFrame(dealt.map(lambda kv: (kv[1],)), T.StructType([T.StructField("row", _plain_schema(schema))]), verifySchema=False)
    _as(rows, schema).write.option("maxRecordsPerFile", 0).parquet(path)


def write_sorted(rows: DataFrame, key: str, path: str, most: int) -> None:
    """``rows`` sorted by ``key`` as Parquet files of ``most`` rows in a new folder; the last file has the rest. Ties go by the other columns."""
    spark = rows.sparkSession
    ship(spark)
    rest = [f"`{f.name}`" for f in rows.schema if f.name != key and not isinstance(f.dataType, T.MapType)]
    placed = _plain(rows.filter(F.col(key).isNotNull()).orderBy(key, *rest)).rdd.zipWithIndex().map(lambda x: ((x[1] // most, x[1]), tuple(x[0])))
    _write_files(spark, placed, -(-rows.filter(F.col(key).isNotNull()).count() // most), rows.schema, path)


@dataclass(frozen=True)
class Cut:
    """How a home's ``n`` rows become ``k`` files: the number of the first, and of the second (the others follow)."""

    n: int
    k: int
    first: int
    rest: int

    def file(self, r: int) -> int:
        """The file of the home's row ``r``: balanced pieces, larger ones first."""
        size, larger = divmod(self.n, self.k)
        piece = r // (size + 1) if r < larger * (size + 1) else larger + (r - larger * (size + 1)) // size
        return self.first if not piece else self.rest + piece - 1


def plan_files(homes: int, counts: dict[int, int], most: int) -> tuple[dict[int, Cut], int]:
    """The cut of every rewritten home, and how many files there are.

    ``counts`` has the rows of each rewritten home. Each home gets the fewest files;
    then, ascending, a file joins the one left of it if that is a rewritten one,
    as grown by then, and both fit into one. Two files of one home never do, so
    only a home's first file can join, and a home needs four numbers, however many files it has.
    """
    cuts, total, left, left_file = {}, 0, None, -1
    for home in range(homes):
        if home not in counts:
            left = None  # a file that stays ends the run
            continue
        n = counts[home]
        if not n:
            continue
        k = -(-n // most)
        first_size = -(-n // k)
        joins = left is not None and left + first_size <= most
        first = left_file if joins else total
        total += not joins
        cuts[home] = Cut(n, k, first, total)
        left, left_file = (left + first_size if joins else first_size, first) if k == 1 else (n // k, total + k - 2)
        total += k - 1
    return cuts, total


def latest(changes: DataFrame, key: str, seq: str, change_id: str) -> DataFrame:
    """The change of each key with the highest ``seq``, then ``change_id``: combined in every task before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    ties = [c for c in rest if c not in (seq, change_id) and not isinstance(changes.schema[c].dataType, T.MapType)]
    order = F.struct(*(F.col(f"`{c}`") for c in [seq, change_id, *ties]))
    best = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), order).alias("best"))
    return best.select(key, *(F.col("best")[c].alias(c) for c in rest))


def replay(part: int, rows: Iterator, places: list[int], width: int, key_at: int) -> Iterator[tuple]:
    """(home, part, place, changed, gone, row) of a partition in order of (home, id, tag, seq, change_id).

    An id's changes (tag 0) come before its rows (tag 1): the last change is held
    and applied to the rows as they pass. A deleted row passes on without values.
    """
    at, change, found = None, None, False
    counts: dict[int, int] = {}

    def out(home: int, changed: bool, row: tuple | None) -> tuple:
        place = counts.get(home, 0)
        if row is not None:
            counts[home] = place + 1
        return home, part, place, changed, row is None, row

    def ended() -> Iterator[tuple]:
        if at is not None and change is not None and not found and change[0] == SET and change[2]:
            new = [None] * width
            new[key_at] = at[1]
            for k, value in zip(places, change[1], strict=True):
                new[k] = value
            yield out(at[0], True, tuple(new))

    for (home, key, tag, _, _), value in rows:
        if (home, key) != at:
            yield from ended()
            at, change, found = (home, key), None, False
            counts = {home: counts.get(home, 0)}
        if tag == 0:
            change = value
            continue
        found = True
        if change is None:
            yield out(home, False, value)
        elif change[0] == DELETE:
            yield out(home, True, None)
        else:
            new = list(value)
            for k, v in zip(places, change[1], strict=True):
                new[k] = v
            same = all(a == b or (a != a and b != b) for a, b in ((value[k], new[k]) for k in places))
            yield out(home, not same, tuple(new))
    yield from ended()


def upsert(spark: SparkSession, path: str, schema: T.StructType, changes: DataFrame, key: str, sets: list[str], action: Callable[[Column], Column], most: int, seq: str = "seq", change_id: str = "change_id") -> list[str]:
    """Applies ``changes`` to the files of ``path`` (sorted by ``key``, a number) and returns the names of the new files.

    ``action`` maps the first key of a change's home to an expression over the
    change's columns: IGNORE, DELETE or SET, which takes over the columns ``sets``
    (nulls too) and inserts absent keys. What an action ignores must depend on
    the home alone or on the latest change. Files hold ``most`` rows at most.
    """
    small_batches(spark, 10_000)
    with staging(spark):
        return _upsert(spark, path, schema, changes, key, sets, action, most, seq, change_id)


def _upsert(spark: SparkSession, path: str, schema: T.StructType, changes: DataFrame, key: str, sets: list[str], action: Callable[[Column], Column], most: int, seq: str, change_id: str) -> list[str]:
    table = spark.read.schema(schema).parquet(path)
    ends = table.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()  # a row per starting file
    ends.sort(key=lambda r: (r["first"], r["last"], r["file"]))
    if not ends:
        return []
    names, firsts, lasts = [r["file"] for r in ends], np.array([r["first"] for r in ends]), np.array([r["last"] for r in ends])
    number = {name: k for k, name in enumerate(names)}

    def homes(ids: pd.Series) -> pd.DataFrame:
        home = np.maximum(np.searchsorted(firsts, ids.to_numpy(), side="right") - 1, 0)
        return pd.DataFrame({"lo": np.minimum(np.searchsorted(lasts, ids.to_numpy(), side="left"), home).astype("int32"), "home": home.astype("int32")})

    home_of = F.pandas_udf(homes, "lo int, home int")
    file_of = F.pandas_udf(lambda names: names.map(number).astype("int32"), "int")

    at, first, home = free_names([*changes.columns, *schema.names], "at", "first", "home")
    won = latest(changes, key, seq, change_id).withColumn(at, home_of(key))
    won = won.withColumn(first, F.get(F.array(*(F.lit(int(x)) for x in firsts)), F.col(at)["home"]))
    place = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_LEAST)).alias(c)
    taken = F.struct(*(F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in sets))
    acted = won.select(F.col(key).alias("id"), place(seq).alias("seq"), place(change_id).alias("change_id"), F.col(at).alias("at"), action(F.col(first)).alias("does"), taken.alias("set"))
    acted = stage(spark, acted.filter(F.col("does") != IGNORE).withColumn("to", F.explode(F.sequence("at.lo", "at.home"))), "upsert-changes")
    touched = [r["to"] for r in acted.select("to").distinct().collect()]  # starting files at most
    if not touched:
        return []
    rows = spark.read.schema(schema).parquet(*(f"{path}/{names[h]}" for h in sorted(touched)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    bounds = acted.select("id").unionByName(rows.select(F.col(key).alias("id"))).agg(F.percentile_approx("id", shares, 10_000)).head()[0]  # a number per task

    plain = _plain_schema(schema).fieldNames()
    places, key_at = [plain.index(c) for c in sets], plain.index(key)
    plain_set = F.struct(*(F.unix_micros(F.col("set")[c]).alias(c) if isinstance(schema[c].dataType, T.TimestampType) else F.col("set")[c].alias(c) for c in sets))
    changed = acted.select("to", "id", "seq", "change_id", "does", plain_set.alias("set"), (F.col("to") == F.col("at.home")).alias("own")).rdd
    changed = changed.map(lambda r: ((r[0], r[1], 0, r[2], r[3]), (r[4], tuple(r[5]), r[6])))
    old = _plain(rows).withColumn(home, file_of(F.col("_metadata.file_name"))).rdd.map(lambda r: ((r[-1], r[key_at], 1, 0, 0), tuple(r[:-1])))
    width, cuts_at = len(plain), sorted(bounds)
    dealt = changed.union(old).repartitionAndSortWithinPartitions(parts, lambda k: bisect_right(cuts_at, k[1]))
    spool_schema = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("changed", T.BooleanType()), T.StructField("gone", T.BooleanType()), T.StructField("row", _plain_schema(schema))])
    spool = stage(spark, spark.createDataFrame(dealt.mapPartitionsWithIndex(lambda k, part: replay(k, part, places, width, key_at)), spool_schema, verifySchema=False), "upsert-spool")

    counted = spool.groupBy("home", "part").agg(F.count_if(~F.col("gone")).alias("n"), F.max("changed").alias("changed")).collect()  # a row per pair of home and task
    rewritten = {r["home"] for r in counted if r["changed"]}
    begin, total = {}, {}
    for r in sorted(counted):
        begin[r["home"], r["part"]] = total.get(r["home"], 0)
        total[r["home"]] = total.get(r["home"], 0) + r["n"]
    cuts, files = plan_files(len(names), {h: total[h] for h in rewritten}, most)

    def placed(r) -> tuple:
        at = begin[r[0], r[1]] + r[2]
        return (cuts[r[0]].file(at), r[0], at), tuple(r[3])

    kept = spool.filter(~F.col("gone") & F.col("home").isin(sorted(rewritten))).select("home", "part", "place", "row").rdd.map(placed)
    new = f"{path}/_rewritten-{uuid.uuid4().hex}"
    _write_files(spark, kept, files, schema, new)

    fs, hidden = _fs(spark, new)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    added = [s.getPath().getName() for s in fs.listStatus(hidden) if s.getPath().getName().startswith("part-")]
    for h in rewritten:
        fs.delete(path_of(f"{path}/{names[h]}"), False)
    for name in added:
        if not fs.rename(path_of(f"{new}/{name}"), path_of(f"{path}/{name}")):
            raise OSError(f"could not move {new}/{name}")
    fs.delete(hidden, True)
    return added


def describe_files(spark: SparkSession, path: str, schema: T.StructType, key: str, cents: Column, crc: Column, new: list[str]) -> DataFrame:
    """first_id, n_rows, cents, rows_crc, ids_sha256, columns, path, rewritten of every file, by reading it in its order.

    A file's rows meet in one task and stream through it; what is held is a digest and three sums.
    """
    small_batches(spark, 10_000)
    rows = spark.read.schema(schema).parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(key).cast("long").alias("id"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents"), crc.cast("long").alias("crc"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # path, first id, rows, cents, crc, hash
        names = ["first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "path"]
        done = lambda h: pa.RecordBatch.from_pydict(dict(zip(names, ([h[1]], [h[2]], [h[3]], [h[4]], [h[5].hexdigest()], [h[0]]), strict=True)))
        for b in batches:
            paths = b.column(0).to_pylist()
            cuts = [0, *(k for k in range(1, len(paths)) if paths[k] != paths[k - 1]), len(paths)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                ids = b.column(2).slice(i, j - i).to_pylist()
                if held is None or held[0] != paths[i]:
                    if held:
                        yield done(held)
                    held = [paths[i], ids[0], 0, 0, 0, hashlib.sha256()]
                held[5].update((("," if held[2] else "") + ",".join(map(str, ids))).encode())
                held[2] += j - i
                held[3] += sum(b.column(3).slice(i, j - i).to_pylist())
                held[4] += sum(b.column(4).slice(i, j - i).to_pylist())
        if held:
            yield done(held)

    found = rows.repartition("path").sortWithinPartitions("path", "at").mapInArrow(digest, "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, path string")
    fresh = F.element_at(F.split("path", "/"), -1).isin(new) if new else F.lit(False)
    return found.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(schema.names)).alias("columns"), "path", fresh.alias("rewritten"))


def op12_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``clients`` after their changes: one row per file."""
    clients, changes = spark.read.parquet(f"{sf_dir}/clients.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet")
    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    folder, most = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}", 1 + clients.count() // 1000
    write_sorted(clients.filter(crc(F.col("client_id")) % 7 > 3), "client_id", folder, most)

    def action(first: Column) -> Column:
        h = crc(first) % 16
        gone = F.col("op").eqNullSafe("D") | F.coalesce(crc(F.col("change_id")) % 8 < h, F.lit(False))
        return F.when(h > 7, IGNORE).when(gone, DELETE).otherwise(SET)

    new = upsert(spark, folder, clients.schema, changes, "client_id", ["source", "segment", "city", "balance"], action, most)
    text = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")))
    return describe_files(spark, folder, clients.schema, "client_id", F.floor(100 * F.col("balance") + 0.5), F.crc32(text.cast("binary")), new)

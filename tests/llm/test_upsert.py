"""The upsert against the contract worked out literally, file by file."""

import hashlib
import math
import random
from zlib import crc32

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import upsert as U
from quern.session import shared_dir

SETS = ["source", "segment", "city", "balance"]


def code(x):
    return crc32(str(x).encode())


def brute(clients: list[dict], changes: list[dict]) -> list[dict]:
    """Every rule of the contract over lists of rows, without a clever step."""
    names = list(clients[0]) if clients else []
    most = 1 + len(clients) // 1000
    base = sorted((r for r in clients if r["client_id"] is not None and code(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [base[k : k + most] for k in range(0, len(base), most)]
    if not files:
        return []
    firsts = [f[0]["client_id"] for f in files]
    won = {}
    for c in changes:
        if c["client_id"] is not None:
            order = lambda r: tuple((v is not None, v or 0) for v in (r["seq"], r["change_id"]))
            if c["client_id"] not in won or order(c) > order(won[c["client_id"]]):
                won[c["client_id"]] = c
    after = [[dict(r) for r in f] for f in files]
    for key, c in won.items():
        home = max([k for k, x in enumerate(firsts) if x <= key], default=0)
        h = code(firsts[home]) % 16
        if h > 7:
            continue
        there = [r for r in after[home] if r["client_id"] == key]
        if c["op"] == "D" or (c["change_id"] is not None and code(c["change_id"]) % 8 < h):
            after[home] = [r for r in after[home] if r["client_id"] != key]
        elif there:
            for r in there:
                r.update({s: c[s] for s in SETS})
        else:
            after[home].append(dict.fromkeys(names) | {"client_id": key} | {s: c[s] for s in SETS})
    out = []
    for old, new in zip(files, after, strict=True):
        new.sort(key=lambda r: r["client_id"])
        if old == new:
            out.append((old, False))
            continue
        k = -(-len(new) // most)
        at = 0
        for i in range(k):
            size = len(new) // k + (i < len(new) % k)
            out.append((new[at : at + size], True))
            at += size
    k = 1
    while k < len(out):
        if out[k][1] and out[k - 1][1] and len(out[k][0]) + len(out[k - 1][0]) <= most:
            out[k - 1 : k + 1] = [(out[k - 1][0] + out[k][0], True)]
        else:
            k += 1
    told = []
    for rows, rewritten in out:
        cents = sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None else 0 for r in rows)
        crc = sum(crc32("|".join(r[c] or "" for c in ("source", "segment", "city")).encode()) for r in rows)
        ids = ",".join(str(r["client_id"]) for r in rows)
        told.append({"first_id": rows[0]["client_id"], "n_rows": len(rows), "cents": cents, "rows_crc": crc, "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(), "columns": ",".join(names), "rewritten": rewritten})
    return told


def told(df):
    return sorted((r.asDict() | {"path": None} for r in df.collect()), key=lambda r: r["first_id"])


def equal(got, want):
    assert [{k: v for k, v in r.items() if k != "path"} for r in got] == want


@pytest.fixture(scope="module")
def shop(spark, small, tmp_path_factory):
    """The tables of sf0.001, and a second shop with odd rows: more rows a file, a hot client, nulls and repeats."""
    folder = str(tmp_path_factory.mktemp("shop"))
    rnd = random.Random(5)
    clients = spark.read.parquet(f"{small}/clients.parquet").drop("client_id")
    rows = [r.asDict() for r in clients.collect()]
    many = [(3 * k, *(rows[k % len(rows)].values())) for k in range(4200)]
    spark.createDataFrame(many, f"client_id long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in clients.schema)}").coalesce(1).write.parquet(f"{folder}/clients.parquet")
    pick = lambda *x: rnd.choice(x)
    change = []
    for k in range(6000):
        key = pick(None, 6, 6, 6, 6, rnd.randrange(13000), rnd.randrange(13000), rnd.randrange(12600, 15000), 12700 + k % 900)
        change.append((pick(k, k, k, None), key, pick(None, rnd.randrange(9), rnd.randrange(9)), pick("U", "I", "D", None, "U"), None, pick("web", None), pick("retail", None, ""), pick("Ünï", None), pick(None, 1.005, -3.5, 10.0), "x"))
    change += change[:50]
    # Of changes alike in client, seq and id the contract names none, so there are none here but for whole repeats.
    seen = {}
    change = [c for c in change if seen.setdefault((c[1], c[2], c[0]), c) == c]
    spark.createDataFrame(change, "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, extra string").coalesce(1).write.parquet(f"{folder}/client_changes.parquet")
    return folder


def rows_of(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def test_equals_the_contract(spark, small, shop):
    for folder in (small, shop):
        got = told(U.op12_upsert(spark, folder))
        want = brute(rows_of(folder, "clients"), [{k: v for k, v in r.items() if k != "extra"} for r in rows_of(folder, "client_changes")])
        equal(got, want)
        assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)
    assert max(r["n_rows"] for r in got) == 5 and min(r["n_rows"] for r in got) >= 1


def test_untouched_rows_keep_every_value(spark, shop):
    df = U.op12_upsert(spark, shop)
    path = df.head()["path"].rsplit("/", 1)[0]
    clients = spark.read.parquet(f"{shop}/clients.parquet")
    kept = spark.read.parquet(path).drop(*SETS).filter("name is not null")
    assert kept.exceptAll(clients.drop(*SETS)).isEmpty()
    assert spark.read.parquet(path).schema == clients.schema


def test_empty_tables(spark, shop, tmp_path):
    clients, changes = (spark.read.parquet(f"{shop}/{t}.parquet") for t in ("clients", "client_changes"))
    for name, a, b in (("none", clients.limit(0), changes), ("calm", clients, changes.limit(0)), ("both", clients.limit(0), changes.limit(0))):
        a.write.parquet(f"{tmp_path}/{name}/clients.parquet")
        b.write.parquet(f"{tmp_path}/{name}/client_changes.parquet")
        got = told(U.op12_upsert(spark, f"{tmp_path}/{name}"))
        assert not any(r["rewritten"] for r in got) and bool(got) == (name == "calm")


def test_a_key_that_lies_in_two_files(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (2, "b", 2.0), (2, "c", None), (3, "d", float("nan"))], "k long, name string, at double")
    path = f"{shared_dir(spark)}/two-files"
    U.write_sorted(rows, "k", path, 2)
    changes = spark.createDataFrame([(2, 1, 1, "new"), (3, 1, 1, "d"), (9, 1, 1, "late")], "k long, seq long, change_id long, name string")
    U.upsert(spark, path, rows.schema, changes, "k", ["name"], lambda first: F.lit(U.SET), 2)
    got = sorted((r["k"], r["name"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a"), (2, "new"), (2, "new"), (2, "new"), (3, "d"), (9, "late")]


def test_times_with_a_zone_stay(spark):
    rows = spark.sql("select id as k, timestamp_micros(1700000000123456 + id) as t, cast(null as timestamp) as u, 'x' as name from range(6)")
    path = f"{shared_dir(spark)}/zoned"
    U.write_sorted(rows, "k", path, 4)
    changes = spark.sql("select 1L as k, 1L as seq, 1L as change_id, 'y' as name")
    assert U.upsert(spark, path, rows.schema, changes, "k", ["name"], lambda first: F.lit(U.SET), 4)
    assert spark.read.parquet(path).drop("name").exceptAll(rows.drop("name")).isEmpty() and spark.read.parquet(path).count() == 6


def test_a_plan_equals_merging_file_by_file():
    rnd = random.Random(1)
    for _ in range(3000):
        most, homes = rnd.randrange(1, 9), rnd.randrange(1, 8)
        counts = {h: rnd.choice([0, 1, 2, rnd.randrange(4 * most)]) for h in range(homes) if rnd.random() < 0.7}
        cuts, total = U.plan_files(homes, counts, most)
        files = []
        for h in range(homes):
            if h not in counts:
                files.append(None)
                continue
            n, k = counts[h], -(-counts[h] // most)
            files += [[(h, n // k + (i < n % k))] for i in range(k)]
        k = 1
        while k < len(files):
            if files[k] and files[k - 1] and sum(x[1] for x in files[k] + files[k - 1]) <= most:
                files[k - 1 : k + 1] = [files[k - 1] + files[k]]
            else:
                k += 1
        want = [[h for h, n in f for _ in range(n)] for f in files if f]
        got = [[] for _ in range(total)]
        for h, cut in cuts.items():
            for r in range(cut.n):
                got[cut.file(r)].append(h)
        assert got == want

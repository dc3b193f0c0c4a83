"""The repair against the contract: all edit sequences of short conversations, a plain recursion for the rest."""

import hashlib
import heapq
import random
import re
import sys
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import conversations as C

sys.setrecursionlimit(20_000)
WHOLE, START = re.compile("(s?(ua)+)?"), re.compile("(s?(ua)*u?)?")


def damaged(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for r in rows:
        plain = lambda c: " " if r[c] is None else r[c]  # noqa: E731, B023
        code, text, role = crc32(f"{plain('conv_id')}:{plain('turn')}".encode()) % 20, plain("text"), plain("role")
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(r["turn"], "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_sequence(rows, fault):
    """Uniform-cost search over all edits, by cost and then by audit."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, k, turns = heapq.heappop(heap)
        roles = "".join(r[:1] or "-" for r, _ in turns)
        if not START.fullmatch(roles):
            continue
        if k == len(rows) and WHOLE.fullmatch(roles):
            return cost, audit, turns
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", k, (*turns, (role, ""))))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, turns))
            if fault[k] not in ("blank", "duplicate"):
                more = 3 if fault[k] else 0
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, (*turns, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, (*turns, (new, text))))


def recursion(rows, fault):
    """The same by remembering, for each turn and last role, the least (cost, audit)."""
    n = len(rows)
    order = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    @lru_cache(None)
    def best(k, last, inserted):
        options = [(0, "", None)] if k == n and last in ("", "a") else []
        if inserted < 2:
            c, a, _ = best(k, order[last][0], inserted + 1)
            options.append((c + 3, "I" + a, None))
        if k < n:
            initial = rows[k][1][:1]
            c, a, _ = best(k + 1, last, 0)
            options.append((c + 4, "D" + a, None))
            if fault[k] not in ("blank", "duplicate"):
                more = 3 if fault[k] else 0
                c, a, _ = best(k + 1, order[last][0], 0)
                options.append((c + 3 + more, "R" + a, None))
                if initial == order[last][0] or initial == "s" and last == "":
                    c, a, _ = best(k + 1, initial, 0)
                    options.append((c + more, "K" + a, None))
        return min(options, default=(10**9, "", None))

    cost, audit, _ = best(0, "", 0)
    turns, last, k = [], "", 0
    for e in audit:
        if e == "K":
            turns.append((rows[k][1], rows[k][2]))
        elif e in "RI":
            turns.append((order[last], rows[k][2] if e == "R" else ""))
        if e != "D":
            last = turns[-1][0][:1]
        k += e != "I"
    return cost, audit, tuple(turns)


def brute(conv_id, rows, exact=False):
    rows = damaged(rows)
    fault = faults(rows)
    cost, audit, turns = (every_sequence if exact else recursion)(rows, fault)
    at = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    return (conv_id, max(at) - min(at) + 1 - len(set(at)) if at else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r["conv_id"], []).append(r)
    return out


def made(seed, conversations, turns):
    """Conversations with every kind of fault, nulls, ties and odd roles."""
    rnd, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rnd.randrange(1, turns)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "Üser", "unknown"])
            text = rnd.choice(["One.", "Two!", "three", "four? ", "five.\n\t", "", " \x0b\x0c", None, " ", "Eins.", f"{rnd.random()}."])
            rows.append({"conv_id": None if conv == 3 else conv, "turn": rnd.choice([turn, turn, 2 * turn, None, 7]), "role": role, "text": text})
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows], "conv_id long, turn long, role string, text string")


def plain(df):
    order = lambda r: (r[0] is not None, r[0] or 0)
    return sorted((tuple(r) for r in df.collect()), key=order)


def want(rows, exact=False):
    return sorted((brute(k, v, exact) for k, v in by_conversation(rows).items()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_short_conversations_equal_all_sequences(spark):
    rows = made(1, 120, 5)
    assert plain(C.repaired(C.damage(frame(spark, rows)))) == want(rows, exact=True)


def test_the_query_equals_the_recursion(spark, small):
    rows = pq.read_table(f"{small}/conversations.parquet").to_pylist()
    assert plain(C.op11_conversations(spark, small)) == want(rows)


@pytest.mark.parametrize("most", [1, 3, 16])
def test_pieces_equal_the_whole(spark, most):
    """Conversations cut into pieces, one of which holds a third of all turns."""
    rows = made(2, 60, 20) + [r | {"conv_id": 5} for r in made(9, 30, 20)]
    got = plain(C.repaired(C.damage(frame(spark, rows)), most=most))
    assert got == want(rows)


def test_equal_turns_are_cut_too(spark):
    rows = [{"conv_id": 1, "turn": 4, "role": "user", "text": "Same."}] * 50 + [{"conv_id": 2, "turn": 1, "role": "system", "text": "One."}]
    df = frame(spark, rows).repartition(3)
    assert plain(C.repaired(C.damage(df), most=4)) == want(rows)


def test_edits_are_the_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "cut"), (1, 2, "user", " "), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    short, long = C.repair(rows)
    got = [tuple(r) for r in short.orderBy("conv_id", "place").collect()]
    assert long is None
    assert got == [
        (1, 0, "I", None, None, None, "user", ""),
        (1, 1, "K", None, 0, "assistant", "assistant", "Hello."),
        (1, 2, "D", "truncated", 1, "user", None, None),
        (1, 3, "D", "blank", 2, "user", None, None),
        (2, 0, "D", "blank", 0, " ", None, None),
    ]


def test_costs_of_a_bucket_do_not_mix():
    rnd = np.random.default_rng(3)
    pieces = [rnd.choice([1, 2, 3, 0, 2 | C.CUT, 3 | C.CUT, C.MUST, 2 | C.MUST | C.CUT], n) for n in rnd.integers(0, 40, 200)]
    assert C.solve(pieces) == [C.solve([p])[0] for p in pieces]


def test_odd_tables(spark):
    rows = frame(spark, made(4, 5, 6)).withColumn("code", F.lit("x")).withColumn("place", F.lit(None).cast("string")).withColumn("piece", F.lit(1))
    assert plain(C.repaired(C.damage(rows))) == plain(C.repaired(C.damage(rows.drop("code", "place", "piece"))))
    assert C.repaired(C.damage(rows.limit(0))).count() == 0
    dropped = frame(spark, [{"conv_id": c, "turn": 0, "role": "user", "text": "Hi."} for c in range(200) if crc32(f"{c}:0".encode()) % 20 == 0])
    got = plain(C.repaired(C.damage(dropped)))
    assert got and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_long_texts(spark):
    rows = [{"conv_id": 1, "turn": k, "role": ("user", "assistant")[k % 2], "text": x} for k, x in enumerate(["." * 200_000, " " * 200_000, "word " * 50_000, "x" * 300_000 + "."])]
    assert plain(C.repaired(C.damage(frame(spark, rows)))) == want(rows)

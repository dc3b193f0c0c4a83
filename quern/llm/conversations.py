"""Conversation repair: the cheapest edits after which a conversation's roles alternate, by dynamic programming over NumPy tensors.

Roles must read ``(s?(ua)+)?`` by their initials. Four states say what has been
put out: nothing, the system turn, a user turn, an assistant turn. Turns may be
kept (free), given another role (3), deleted (4; blank and repeated turns must
be) or inserted (3), and what is left truncated costs 3 more.

Conversations are bucketed by length and laid out time-major, turns x
conversations. Going backward, every turn updates the least cost to the end from
each state for all conversations of the bucket at once; these costs are stored,
and the trace goes forward through them, again for all conversations at once,
taking the first of D, I, K, R that keeps to the least cost, which gives the
ASCII-least audit.

A conversation of more than ``most`` turns is cut into pieces, by a range
partitioning on its turns, so no task ever holds a long one. A piece's costs are a 4 x 4
matrix (from state, to state); folding these from the end gives each piece
the costs behind it, each piece is then traced from all four states, and folding
their exits from the front tells which trace counts. Only a long conversation's
digest reads it whole, turn by turn, since a hash and an audit are sequential.

Nulls and limits: null values count as one space in ``damage``; in ``repair`` a
null role or text does too; null turns come first, ties go by role and
text; a null ``conv_id`` is a conversation of its own; repeated rows are turns
that repeat; texts of any length are whole; a conversation without turns has one
row without an edit; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import small_batches, stage

#: Costs of the edits, and of leaving a truncated turn.
RETOLD, DELETED, INSERTED, TRUNCATED = 3, 4, 3, 3
#: States: nothing, system, user, assistant put out; the state after the role that each expects, and that role.
AFTER, EXPECTED = np.array([2, 2, 3, 2]), ("user", "user", "assistant", "user")
#: A turn's code: its initial (0 other, 1 s, 2 u, 3 a), whether it must go, whether it is truncated, and what lies behind the end.
MUST, CUT, PAD = 4, 8, 16
FAR = 1 << 40
#: Costs at a conversation's end: nothing or an assistant's turn may end it, one or two inserted turns complete the others.
END = np.array([0, 2 * INSERTED, INSERTED, 0])
#: What white space is here.
SPACE = " \t\n\x0b\x0c\r"
#: Turns that one piece holds, and turns and characters of the conversations that a task solves at once.
MOST, TURNS, CHARACTERS = 16_384, 32_768, 8_000_000


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by the CRC of their place; dropped turns stay as rows that are not ``here``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") != 0).alias("here"), F.explode(copies).alias("copy")).drop("copy")


def _codes(role: Column, text: Column) -> Column:
    """A turn's code, but for its being repeated."""
    last, first = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1)), F.substring(role, 1, 1)
    kind = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    return (kind + F.when(last == "", MUST).when(last.isin(".", "!", "?"), 0).otherwise(CUT)).cast("int")


def tensor(pieces: list[np.ndarray]) -> np.ndarray:
    """Codes of several conversations, time-major and padded."""
    out = np.full((max(map(len, pieces)), len(pieces)), PAD, np.int64)
    for k, piece in enumerate(pieces):
        out[: len(piece), k] = piece
    return out


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs to the end, turns + 1 x conversations x states, from the costs ``ends`` behind the last turn (conversations x states)."""
    steps, many = codes.shape
    costs = np.empty((steps + 1, many, 4), np.int64)
    costs[steps] = ends
    for t in range(steps - 1, -1, -1):
        code, behind = codes[t], costs[t + 1]
        kind, must = code & 3, (code & MUST) > 0
        more = np.where((code & CUT) > 0, TRUNCATED, 0) + np.where(must, FAR, 0)
        now = np.minimum(behind + DELETED, behind[:, AFTER] + (RETOLD + more)[:, None])
        keep = np.full((many, 4), FAR)
        for initial, states, to in ((1, [0], 1), (2, [0, 1, 3], 2), (3, [2], 3)):
            keep[np.ix_(kind == initial, states)] = behind[kind == initial, to][:, None]
        now = np.minimum(now, keep + more[:, None])
        user, assistant = np.minimum(now[:, 2], now[:, 3] + INSERTED), np.minimum(now[:, 3], now[:, 2] + INSERTED)
        now = np.stack([np.minimum(now[:, 0], user + INSERTED), np.minimum(now[:, 1], user + INSERTED), user, assistant], 1)
        costs[t] = np.where((code == PAD)[:, None], behind, np.minimum(now, FAR))
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, enter: np.ndarray, last: bool) -> tuple[list[str], np.ndarray]:
    """The ASCII-least cheapest edits of every conversation from its state ``enter`` on, and the state in which each ends.

    A piece that is not the ``last`` ends with its last turn: what is inserted there belongs to the next one.
    """
    steps, many = codes.shape
    length, row = (codes != PAD).sum(0), np.arange(many)
    t, state, out = np.zeros(many, int), enter.copy(), []
    padded = np.vstack([codes, np.full((1, many), PAD)])
    while True:
        now, end = costs[t, row, state], t == length
        done = end & ((now == 0) if last else True)
        if done.all():
            break
        code, behind = padded[t, row], np.minimum(t + 1, steps)
        kind, more = code & 3, np.where((code & CUT) > 0, TRUNCATED, 0)
        stays = ~end & ((code & MUST) == 0)
        legal = ((kind == 1) & (state == 0)) | ((kind == 2) & (state != 2)) | ((kind == 3) & (state == 2))
        deleted = ~end & (costs[behind, row, state] + DELETED == now)
        inserted = costs[t, row, AFTER[state]] + INSERTED == now
        kept = stays & legal & (costs[behind, row, kind] + more == now)
        edit = np.select([done, deleted, inserted, kept], [0, 68, 73, 75], 82).astype(np.uint8)
        out.append(edit)
        state = np.select([edit == 75, (edit == 73) | (edit == 82)], [kind, AFTER[state]], state)
        t = t + ((edit == 68) | (edit == 75) | (edit == 82))
    if not out:
        return [""] * many, state
    audits = np.stack(out, 1)
    return [bytes(a[a > 0]).decode() for a in audits], state


def solve(pieces: list[np.ndarray]) -> list[str]:
    """The audits of whole conversations, bucketed by length."""
    audits = [""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        buckets.setdefault(len(piece).bit_length(), []).append(k)
    for size, own in buckets.items():
        if not size:
            continue  # nothing is left of these, and nothing is a legal conversation
        codes = tensor([pieces[k] for k in own])
        found, _ = trace(codes, backward(codes, np.tile(END, (len(own), 1))), np.zeros(len(own), int), True)
        for k, audit in zip(own, found, strict=True):
            audits[k] = audit
    return audits


FIELDS = "place long, edit string, fault string, turn {turn}, was string, role string, text string"


def _fault(code: int) -> str | None:
    return ("duplicate" if code & CUT else "blank") if code & MUST else "truncated" if code & CUT else None


def _edited(audit: str, turns: list[tuple], codes: list[int], state: int = 0, begin: int = 0) -> Iterator[tuple]:
    """A row for each edit: place, edit, fault, turn, role before, role and text after."""
    k = 0
    for place, edit in enumerate(audit, begin):
        if edit == "I":
            yield place, edit, None, None, None, EXPECTED[state], ""
            state = int(AFTER[state])
            continue
        turn, role, text = turns[k]
        code = codes[k]
        k += 1
        if edit == "D":
            yield place, edit, _fault(code), turn, role, None, None
            continue
        yield place, edit, _fault(code), turn, role, role if edit == "K" else EXPECTED[state], text
        state = code & 3 if edit == "K" else int(AFTER[state])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(df: DataFrame, names: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*names).schema)


def _repair_short(rows: DataFrame) -> DataFrame:
    """Edits of conversations that fit into a task: rows (conv_id, turn, role, text, here, code) stream in order, some thousand turns at a time."""
    shape = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FIELDS.format(turn=rows.schema['turn'].dataType.simpleString())}"
    schema = _schema(rows.sparkSession.createDataFrame([], shape), [f.split()[0] for f in shape.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # conv_id, turns, codes
        size = characters = 0
        said: set = set()

        def flush() -> Iterator[pa.RecordBatch]:
            audits = solve([np.array(c, np.int64) for _, _, c in held])
            out = []
            for (name, turns, codes), audit in zip(held, audits, strict=True):
                out += [(name, *r) for r in _edited(audit, turns, codes)] or [(name, *[None] * 7)]
                if len(out) >= 4096:
                    yield _table(out, schema)
                    out = []
            if out:
                yield _table(out, schema)

        first = True
        for b in batches:
            for name, turn, role, text, here, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first or name != held[-1][0]:
                    if size > TURNS or characters > CHARACTERS:
                        yield from flush()
                        held, size, characters = [], 0, 0
                    first = False
                    held.append((name, [], []))
                    said = set()
                if not here:
                    continue
                if not code & MUST:
                    code = code | MUST | CUT if (role, text) in said else code
                    said.add((role, text))
                held[-1][1].append((turn, role, text))
                held[-1][2].append(code)
                size, characters = size + 1, characters + len(text)
        if held:
            yield from flush()

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, shape)


def _grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows that share their first ``columns`` values, with the lists of the others."""
    held, values = None, []
    for b in batches:
        lists = [c.to_pylist() for c in b.columns]
        for row in zip(*lists, strict=True):
            if held is None or row[:columns] != held:
                if held is not None:
                    yield held, values
                held, values = row[:columns], []
            values.append(row[columns:])
    if held is not None:
        yield held, values


def _repair_long(rows: DataFrame, turns: int, most: int) -> DataFrame:
    """Edits of long conversations, piece by piece; ``rows`` as for short ones, all here."""
    spark = rows.sparkSession
    conv, turn = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    # Rows alike in everything are told apart by their place, so they can be cut too.
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-turns // most)), "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie").select("conv_id", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "code")
    dealt = stage(spark, dealt, "conversation-turns")
    # The first of equal turns: a combining aggregate, then a join on the row's own place, so no frequent turn gathers anywhere.
    first = dealt.filter(F.col("code").bitwiseAND(MUST) == 0).groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("said")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    repeated = (F.col("code").bitwiseAND(MUST) == 0) & F.col("first").isNull()
    coded = stage(spark, dealt.join(first, "pos", "left").withColumn("code", F.when(repeated, F.col("code").bitwiseOR(MUST | CUT)).otherwise(F.col("code"))).drop("first"), "conversation-codes")
    brief = coded.select("conv_id", "piece", "pos", "code").repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "pos")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, piece), values in _grouped(batches, 2):
            codes = np.repeat(np.array([v[1] for v in values], np.int64)[:, None], 4, 1)
            costs = backward(codes, np.where(np.eye(4, dtype=bool), 0, FAR))[0]  # to state x from state
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([name], schema_id), "piece": pa.array([piece], pa.int32()), "costs": [costs.T.ravel().tolist()]})

    schema_id = _schema(rows, ["conv_id"]).field(0).type

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a conversation from the last on: the costs behind each."""
        held, costs = None, END
        for b in batches:
            out = []
            for name, piece, matrix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fresh = held is None or held[0] != name
                held, costs = (name,), END if fresh else costs
                out.append((name, piece, costs.tolist(), fresh))
                costs = np.minimum((np.array(matrix).reshape(4, 4) + costs).min(1), FAR)
            if out:
                yield _table(out, pa.schema([("conv_id", schema_id), ("piece", pa.int32()), ("ends", pa.list_(pa.int64())), ("last", pa.bool_())]))

    ends = brief.mapInArrow(matrices, f"conv_id {conv}, piece int, costs array<long>").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(behind, f"conv_id {conv}, piece int, ends array<long>, last boolean")
    ends = stage(spark, ends, "conversation-ends")

    def traced(a: pa.Table, b: pa.Table) -> pa.Table:
        codes = np.repeat(np.array(a.sort_by("pos").column("code").to_pylist(), np.int64)[:, None], 4, 1)
        audits, exits = trace(codes, backward(codes, np.tile(np.array(b.column("ends").to_pylist()[0]), (4, 1))), np.arange(4), b.column("last").to_pylist()[0])
        return pa.table({"conv_id": pa.array(b.column("conv_id").to_pylist()[:1], schema_id), "piece": pa.array(b.column("piece").to_pylist()[:1], pa.int32()), "audits": [audits], "exits": [exits.tolist()]})

    four = coded.select("conv_id", "piece", "pos", "code").groupBy("conv_id", "piece").cogroup(ends.groupBy("conv_id", "piece")).applyInArrow(traced, f"conv_id {conv}, piece int, audits array<string>, exits array<long>")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a conversation from the first on: the state in which each is entered, its edits, and how many came before."""
        held, state, begin = None, 0, 0
        for b in batches:
            out = []
            for name, piece, audits, exits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or held[0] != name:
                    held, state, begin = (name,), 0, 0
                out.append((name, piece, audits[state], state, begin))
                begin, state = begin + len(audits[state]), exits[state]
            if out:
                yield _table(out, pa.schema([("conv_id", schema_id), ("piece", pa.int32()), ("audit", pa.string()), ("state", pa.int32()), ("begin", pa.int64())]))

    audits = four.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(chosen, f"conv_id {conv}, piece int, audit string, state int, begin long")
    shape = f"conv_id {conv}, {FIELDS.format(turn=turn)}"
    schema = _schema(spark.createDataFrame([], shape), [f.split()[0] for f in shape.split(", ")])

    def edits(a: pa.Table, b: pa.Table) -> pa.Table:
        name, audit, state, begin = (b.column(c).to_pylist()[0] for c in ("conv_id", "audit", "state", "begin"))
        a = a.sort_by("pos")
        turns = list(zip(*(a.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True))
        out = [(name, *r) for r in _edited(audit, turns, a.column("code").to_pylist(), state, begin)]
        return pa.Table.from_batches([_table(out, schema)])

    return coded.groupBy("conv_id", "piece").cogroup(audits.groupBy("conv_id", "piece")).applyInArrow(edits, shape)


def repair(turns: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """Edits (conv_id, place, edit, fault, turn, was, role, text): those of short conversations, and of long ones if there are any.

    ``turns`` has conv_id, turn, role, text, and ``here`` where rows may only stand
    for their conversation. The kept turns are those with a ``role`` after the edits.
    Short conversations come in order, each in one partition; long ones in pieces, to be ordered by ``place``.
    """
    spark = turns.sparkSession
    small_batches(spark, 4096)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    here = F.coalesce("here", F.lit(False)) if "here" in turns.columns else F.lit(True)
    rows = turns.select("conv_id", "turn", blank("role"), blank("text"), here.alias("here"))
    rows = rows.withColumn("code", _codes(F.col("role"), F.col("text")))
    long = rows.filter("here").groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    totals = long.agg(F.count("*").alias("names"), F.sum("n").alias("turns")).head()
    if not totals["names"]:
        return _repair_short(rows), None
    names = stage(spark, long.select(F.col("conv_id").alias("long_id")), "conversation-long")
    names = F.broadcast(names) if totals["names"] <= 100_000 else names
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _repair_short(rows.join(names, same, "left_anti")), _repair_long(rows.filter("here").join(names, same, "left_semi"), totals["turns"], most)


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation out of its edits in order: counts, cost, audit and the hash of the repaired turns. What is held is the audit and sums."""
    conv = edits.schema["conv_id"].dataType.simpleString()
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", _schema(edits, ["conv_id"]).field(0).type), *((s, pa.int64()) for s in sums), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    legal = {"su", "ua", "au"}
    cost = {"K": 0, "R": RETOLD, "D": DELETED, "I": INSERTED}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, out = None, True, []
        n: dict = {}

        def ended() -> tuple:
            gaps = n["turn"] - n["least"] + 1 - n["turns"] if n["turns"] else 0
            return name, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], n["cost"], "".join(n["audit"]), n["hash"].hexdigest()

        for b in batches:
            for conv_id, _, edit, fault, turn, was, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first or conv_id != name:
                    if not first:
                        out.append(ended())
                    name, first = conv_id, False
                    n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "turn": None, "least": None, "was": None, "audit": [], "hash": hashlib.sha256(), "any": False}
                if edit is None:
                    continue
                n["audit"].append(edit)
                n["cost"] += cost[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if fault:
                    n[fault] += 1
                if edit != "I":
                    if turn is not None:
                        n["least"] = turn if n["least"] is None else n["least"]
                        n["turns"] += turn != n["turn"]
                        n["turn"] = turn
                    n["illegal"] += n["was"] is not None and n["was"][:1] + was[:1] not in legal
                    n["was"] = was
                if role is not None:
                    n["hash"].update((("\n" if n["any"] else "") + f"{role}:{text}").encode())
                    n["any"] = True
            if out:
                yield _table(out, schema)
                out = []
        if not first:
            yield _table([ended()], schema)

    return edits.mapInArrow(run, f"conv_id {conv}, {', '.join(f'{s} long' for s in sums)}, audit string, repaired_sha256 string")


def repaired(turns: DataFrame, most: int = MOST) -> DataFrame:
    """The digest of every conversation of ``turns``."""
    short, long = repair(turns, most)
    if long is None:
        return digest(short)
    return digest(short).unionByName(digest(long.repartition("conv_id").sortWithinPartitions("conv_id", "place")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(damage(turns))

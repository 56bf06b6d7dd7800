"""Conversation structure repair: a time-major numpy tensor DP over edits of turns.

A conversation may be repaired by keeping, renaming the role of, deleting or inserting turns, until its
roles are `(system? (user assistant)+)?`. The state before a turn is what has been written so far:
nothing, system, user or assistant. Spark finds each turn's fault and place; conversations become one
row of turns each and are bucketed by length. A bucket is one tensor [turn, conversation, state]: costs
are filled backwards, a turn of all conversations at once, and edits are traced forwards likewise, the
ASCII-least of the cheapest at each step.

A conversation of many turns is cut into blocks of at most BLOCK turns and about BLOCK_BYTES. Its
blocks' costs between all states (4 x 4) are found first, then carried from its end to its beginning
and its states from its beginning to its end, and then each block is repaired on its own. So no task
holds more than a block's texts and, for one conversation, 20 numbers a block. The digest of what is
repaired is one running SHA-256, which nothing can split: it is fed block by block.

Defined results: a null role or text is one space, a null conversation or turn number too in the key
that says how a row is damaged; a null conversation is one like any other; turns of one number
are ordered by role and text; a null turn number comes first and counts in no gap; roles are known by
their first letter and case; empty texts are blank; extra columns are ignored; an empty table gives an
empty result; a conversation with no rows left has zeros, no edits and the digest of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, small_batches, stored

#: Costs of the edits (fixed values of the contract): renaming a role, deleting, inserting, leaving a cut-off text.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The edits in the order that breaks ties, and no edit.
NAMES = np.frombuffer(b"DIKR\0", np.uint8)
D, I, K, R, NONE = range(5)
#: States: nothing, system, user, assistant. The state that an inserted or renamed turn leads to.
FORCED = np.array([2, 2, 3, 2])
ROLE = ["", "system", "user", "assistant"]
FAR = 1 << 40
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: How a turn looks to the DP: role 0 (other), 1 (s), 2 (u), 3 (a); plus 4 if cut off; 8 if it must go.
CUT_OFF, MUST_GO = 4, 8
#: Turns times conversations of a tensor, at most.
CELLS = 1 << 18

VISIBLE = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows after damage by crc32 of `conv_id:turn` modulo 20."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))


def examined(rows: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with the block and place of each turn in its conversation, its look, and what it adds to the counts.

    One shuffle by conversation serves all windows; Spark sorts with spills.
    """
    initial = F.substring("role", 1, 1)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "_copy")
    weight = F.lit(1) + F.floor(F.octet_length("text") * F.lit(block) / F.lit(block_bytes))
    placed = rows.withColumns({
        "_place": F.row_number().over(order),
        "_block": F.floor(F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / block),
        "_before": F.lag(initial).over(order),
        "_turn_before": F.lag("turn").over(order),
    })
    same = Window.partitionBy("conv_id", "role", F.unhex(F.sha2("text", 256))).orderBy("_place")
    blank = ~F.col("text").rlike(VISIBLE)
    seen = F.row_number().over(same) > 1
    cut = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    fault = F.when(blank, "blank").when(seen, "duplicate").when(cut, "truncated").otherwise("")
    look = F.when(F.col("_fault").isin("blank", "duplicate"), MUST_GO).when(F.col("_fault") == "truncated", CUT_OFF).otherwise(0)
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    pair = F.concat("_before", initial)
    out = placed.withColumn("_fault", fault)
    return out.select(
        "conv_id", "turn", "role", "text", "_place", "_block", "_fault", (look + role).cast("byte").alias("_look"),
        (F.col("_before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("_illegal"),
        (F.col("turn").isNotNull() & (F.col("_turn_before").isNull() | (F.col("_turn_before") != F.col("turn")))).alias("_new_turn"),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """One row per block: conv_id, _block, looks, roles and texts in order, and sums of the counts."""
    count = lambda of, name: F.sum(F.when(of, 1).otherwise(0)).cast("long").alias(name)
    turns = F.array_sort(F.collect_list(F.struct("_place", "_look", "role", "text")))
    out = rows.groupBy("conv_id", "_block").agg(
        turns.alias("_turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), count(F.col("_new_turn"), "turns"), count(F.col("_illegal"), "illegal"),
        *[count(F.col("_fault") == x, x) for x in ("blank", "duplicate", "truncated")],
    )
    return out.select("*", F.col("_turns._look").alias("looks"), F.col("_turns.role").alias("roles"), F.col("_turns.text").alias("texts")).drop("_turns")


# ---- the tensor


def looks_of(column: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-major looks [turn, conversation] of the rows at, and their lengths."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    n = offsets[at + 1] - offsets[at]
    t = np.arange(int(n.max(initial=0)))[:, None]
    inside = t < n
    out = np.zeros(inside.shape, np.int8)
    out[inside] = values[(offsets[at] + t)[inside]]
    return out, n


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs [..., state] if turns may be inserted first; more than two never pay."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[..., FORCED])
    return cost


def step_costs(look: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [..., state] of deleting, keeping and renaming a turn, given the costs after it."""
    role, stays = look & 3, np.where(look & CUT_OFF, TRUNCATED, 0)[..., None]
    gone = (look & MUST_GO > 0)[..., None]
    state = np.arange(4)
    fits = ((role == 1)[..., None] & (state == 0)) | ((role == 2)[..., None] & (state != 2)) | ((role == 3)[..., None] & (state == 2))
    kept = np.take_along_axis(after, np.broadcast_to(role[..., None], after.shape[:-1] + (1,)), -1)
    return DELETE + after, np.where(fits & ~gone, stays + kept, FAR), np.where(gone, FAR, REROLE + stays + after[..., FORCED])


#: What the end of a conversation costs: it has nothing, or ends with an assistant.
END = np.array([0, FAR, FAR, 0], np.int64)


def backward(looks: np.ndarray, n: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs [turn + 1, conversation, state] to the end; end [conversation, state]: what comes after the last turn costs."""
    out = np.empty((len(looks) + 1, len(n), 4), np.int64)
    out[-1] = end
    for t in range(len(looks) - 1, -1, -1):
        best = with_inserts(np.minimum.reduce(step_costs(looks[t], out[t + 1])))
        out[t] = np.where((t < n)[:, None], best, end)
    return out


def traced(looks: np.ndarray, n: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits [step, conversation], three steps a turn (NONE where there is none), and the states at the end.

    At most two turns are inserted before a turn or, if last, at the end.
    """
    state, steps, every = state.copy(), [], np.arange(len(n))
    for t in range(len(looks) + 1):
        here = t < n
        ending = last & (t == n)
        open_ = here | ending
        if not open_.any():
            break
        look = looks[t] if t < len(looks) else np.zeros(len(n), np.int8)
        after = costs[min(t + 1, len(looks))]
        ways = [w[every] for w in step_costs(look, after)]
        for _ in range(3):
            now = costs[t][every, state]
            to = FORCED[state]
            edit = np.select(
                [here & (ways[0][every, state] == now), (INSERT + costs[t][every, to] == now) & (now < FAR), here & (ways[1][every, state] == now), here], [D, I, K, R], NONE
            )
            edit = np.where(open_, edit, NONE)
            state = np.where(edit == K, look & 3, np.where((edit == I) | (edit == R), to, state))
            steps.append(edit.astype(np.int8))
            open_ = open_ & (edit == I)
    return np.array(steps, np.int8).reshape(-1, len(n)), state


def ends_of(end: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Before the end of a conversation turns may be inserted; before that of a block the next one does so."""
    return np.where(last[:, None], with_inserts(end), end)


def repaired(edits: np.ndarray, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """`role:text` of what is left, of one block; state: before its first turn."""
    out, at = [], 0
    for e in edits.tolist():
        if e == I:
            state = int(FORCED[state])
            out.append(f"{ROLE[state]}:")
            continue
        if e == K:
            state = {"s": 1, "u": 2, "a": 3}[roles[at][0]]
            out.append(f"{roles[at]}:{texts[at]}")
        elif e == R:
            state = int(FORCED[state])
            out.append(f"{ROLE[state]}:{texts[at]}")
        at += 1
    return out


def buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of about one length, in tensors of bounded size."""
    kind = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        each = max(1, CELLS >> k)
        for begin in range(0, len(at), each):
            yield at[begin : begin + each]


def matrix_of(column: pa.Array) -> np.ndarray:
    """[row, 4] of an array column of four numbers, whatever slice of a batch it is."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).astype(np.int64)


def solved(table: pa.RecordBatch, digest: bool) -> Iterator[tuple[int, int, bytes, list[str]]]:
    """(row, cost from its state, audit, repaired turns) of each block of a batch with looks, roles, texts, state, end and last."""
    looks_col = table.column("looks")
    sizes = np.diff(looks_col.offsets.to_numpy())
    end, state = matrix_of(table.column("end")), table.column("state").to_numpy()
    last = table.column("last").to_numpy(zero_copy_only=False)
    roles, texts = table.column("roles"), table.column("texts")
    for at in buckets(sizes):
        looks, n = looks_of(looks_col, at)
        costs = backward(looks, n, ends_of(end[at], last[at]))
        edits, _ = traced(looks, n, costs, state[at], last[at])
        for i, row in enumerate(at.tolist()):
            own = edits[:, i]
            own = own[own != NONE]
            turns = repaired(own, int(state[row]), roles[row].as_py(), texts[row].as_py()) if digest else []
            yield row, int(costs[0, i, state[row]]), NAMES[own].tobytes(), turns


# ---- blocks of long conversations


def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the costs (16) from each state before it to each state after it."""
    for b in batches:
        looks_col = b.column("looks")
        sizes = np.diff(looks_col.offsets.to_numpy())
        out = np.empty((b.num_rows, 4, 4), np.int64)
        for at in buckets(sizes):
            looks, n = looks_of(looks_col, at)
            for to in range(4):
                end = np.full((len(at), 4), FAR, np.int64)
                end[:, to] = 0
                out[at, :, to] = backward(looks, n, end)[0]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("_block"), pa.array(out.reshape(len(out), 16).tolist(), pa.list_(pa.int64()))], ["conv_id", "_block", "costs"])


def carried_back(part: pa.Table) -> pa.Table:
    """What follows each block of one conversation costs, by the state after it."""
    part = part.sort_by("_block")
    costs = [np.array(x, np.int64).reshape(4, 4) for x in part.column("costs").to_pylist()]
    ends, after = [END], with_inserts(END)
    for c in costs[:0:-1]:
        after = np.minimum(FAR, (c + after).min(axis=1))
        ends.append(after)
    return pa.table({"conv_id": part.column("conv_id"), "_block": part.column("_block"), "end": pa.array([e.tolist() for e in reversed(ends)], pa.list_(pa.int64()))})


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each block, for each state before it."""
    for b in batches:
        looks_col = b.column("looks")
        sizes, end = np.diff(looks_col.offsets.to_numpy()), matrix_of(b.column("end"))
        last = b.column("last").to_numpy(zero_copy_only=False)
        out = np.empty((b.num_rows, 4), np.int64)
        for at in buckets(sizes):
            looks, n = looks_of(looks_col, at)
            costs = backward(looks, n, ends_of(end[at], last[at]))
            for s in range(4):
                out[at, s] = traced(looks, n, costs, np.full(len(at), s), last[at])[1]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("_block"), pa.array(out.tolist(), pa.list_(pa.int64()))], ["conv_id", "_block", "exits"])


def carried_on(part: pa.Table) -> pa.Table:
    """The state before each block of one conversation."""
    part = part.sort_by("_block")
    states = [0]
    for to in part.column("exits").to_pylist()[:-1]:
        states.append(to[states[-1]])
    return pa.table({"conv_id": part.column("conv_id"), "_block": part.column("_block"), "state": pa.array(states, pa.int32())})


def entries(held: DataFrame) -> DataFrame:
    """conv_id, _block, state, end of each block of conversations that have several."""
    kind = held.schema["conv_id"].dataType.simpleString()
    key = f"conv_id {kind}, _block long"
    several = held.groupBy("conv_id").agg(F.max("_block").alias("_last")).where("_last > 0")
    cut = several.withColumnRenamed("conv_id", "_id")
    long = held.select("conv_id", "_block", "looks").join(cut, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "_block", "looks", (F.col("_block") == F.col("_last")).alias("last"))
    long = stored(long)
    ends = stored(long.select("conv_id", "_block", "looks").mapInArrow(transfers, f"{key}, costs array<long>").groupBy("conv_id").applyInArrow(carried_back, f"{key}, end array<long>"))
    told = met(long, ends, "inner")
    states = told.mapInArrow(exits, f"{key}, exits array<long>").groupBy("conv_id").applyInArrow(carried_on, f"{key}, state int")
    out = stored(met(ends, states, "inner"))
    discard(long, ends)
    return out


def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join by conversation (null is one) and block; the key columns of left stay."""
    other = right.withColumnsRenamed({"conv_id": "_id", "_block": "_at"})
    return left.join(other, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("_block") == F.col("_at")), how).drop("_id", "_at")


# ---- results


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's cost before it, audit and repaired turns; where a conversation is one block, their digest instead."""
    for b in batches:
        cost, audit, digest, body = [0] * b.num_rows, [""] * b.num_rows, [""] * b.num_rows, [None] * b.num_rows
        whole = b.column("whole").to_pylist()
        for row, c, names, turns in solved(b, True):
            cost[row], audit[row] = c, names.decode()
            text = "\n".join(turns)
            if whole[row]:
                digest[row] = hashlib.sha256(text.encode()).hexdigest()
            elif turns:
                body[row] = text
        yield pa.RecordBatch.from_arrays(
            [*[b.column(x) for x in ("conv_id", "_block", *SUMS)], pa.array(cost, pa.int64()), pa.array(audit), pa.array(digest), pa.array(body, pa.string())], ["conv_id", "_block", *SUMS, "cost", "audit", "repaired_sha256", "body"]
        )


SUMS = ["low", "high", "turns", "illegal", "blank", "duplicate", "truncated"]


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the digest of its bodies, which come in order."""
    key, state, first = object(), None, True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    for b in batches:
        kind = b.column("conv_id").type
        for conv, body in zip(b.column("conv_id").to_pylist(), b.column("body")):
            if state is None or conv != key:
                if state is not None:
                    yield row()
                key, state, first = conv, hashlib.sha256(), True
            if body.is_valid:
                state.update(("" if first else "\n").encode() + body.as_py().encode())
                first = False
    if state is not None:
        yield row()


def repairs(conversations: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage."""
    small_batches(conversations.sparkSession)
    conv, turn = conversations.schema["conv_id"].dataType.simpleString(), conversations.schema["turn"].dataType.simpleString()
    held = stored(blocks(examined(damaged(conversations), block, block_bytes)))
    one = F.col("_block") == 0
    if held.where("_block > 0").isEmpty():
        told = held.withColumns({"state": F.lit(0), "end": F.lit(None), "last": F.lit(True), "whole": F.lit(True)})
    else:
        known = entries(held).withColumn("several", F.lit(True))
        ends = known.groupBy("conv_id").agg(F.max("_block").alias("_last")).withColumnRenamed("conv_id", "_own")
        told = met(held, known, "left").join(ends, F.col("conv_id").eqNullSafe(F.col("_own")), "left").drop("_own")
        told = told.withColumns({"state": F.coalesce("state", F.lit(0)), "last": F.col("_last").isNull() | (F.col("_block") == F.col("_last")), "whole": F.col("several").isNull()}).drop("several", "_last")
    told = told.withColumn("end", F.coalesce(F.col("end"), F.array(*[F.lit(int(x)) for x in END]).cast("array<long>")))
    schema = f"conv_id {conv}, _block long, low {turn}, high {turn}, turns long, illegal long, blank long, duplicate long, truncated long, cost long, audit string, repaired_sha256 string, body string"
    parts = stored(told.select("conv_id", "_block", *SUMS, "looks", "roles", "texts", "state", "end", "last", "whole").mapInArrow(pieces, schema))
    discard(held)
    single = parts.where("repaired_sha256 <> ''").select("conv_id", *SUMS, "cost", "audit", "repaired_sha256")
    long = parts.where("repaired_sha256 = ''")
    # A conversation's blocks come in order to one task, which holds one at a time.
    streamed = long.select("conv_id", "_block", "body").repartition("conv_id").sortWithinPartitions("conv_id", "_block").mapInArrow(digests, f"conv_id {conv}, repaired_sha256 string").withColumnRenamed("conv_id", "_id")
    summed = long.groupBy("conv_id").agg(
        *[F.sum(x).alias(x) for x in ("illegal", "blank", "duplicate", "truncated")], F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"),
        F.max(F.when(one, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    several = summed.join(streamed, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    found = single.unionByName(several.select(*single.columns)).withColumnRenamed("conv_id", "_id")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    number = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    return every.select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[number(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _plus(way: str, cost: str, edit: str) -> str:
    """SQL for a way (8 digits of its cost, then its edits) and one more edit."""
    return f"lpad((left({way}, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({way}, 9) || '{edit}'"


_INSERTED = f"""SELECT *, least(a, {_plus("u", "3", "I")}) AS a1 FROM (
      SELECT * REPLACE (least(u, {_plus("w", "3", "I")}, {_plus("s", "3", "I")}, {_plus("a", "3", "I")}) AS u) FROM {{}})"""
_CUT = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
_RENAMED = f"3 + {_CUT}"
_STAYS, _IS = "fault NOT IN ('blank', 'duplicate')", "CASE WHEN {} AND initial = '{}' THEN {} END"

#: Of all ways to each state (w nothing, s system, u user, a assistant) the cheapest, then ASCII-least, is carried from turn to turn.
ORACLE = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), o AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER w AS place, lag(left(role, 1)) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
    before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal FROM o
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate,
    count_if(fault = 'truncated')::BIGINT AS truncated, count_if(illegal)::BIGINT AS illegal, max(place) AS n FROM f GROUP BY conv_id
), r AS (
  SELECT conv_id, 0::BIGINT AS t, '00000000'::VARCHAR AS w, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM c
  UNION ALL
  SELECT conv_id, t + 1, {_plus("w", "4", "D")},
    least({_plus("s", "4", "D")}, {_IS.format(_STAYS, "s", _plus("w", _CUT, "K"))}),
    least({_plus("u", "4", "D")}, {", ".join(_IS.format(_STAYS, "u", _plus(x, _CUT, "K")) for x in ("w", "s", "a1"))}, {", ".join(f"CASE WHEN {_STAYS} THEN {_plus(x, _RENAMED, 'R')} END" for x in ("w", "s", "a1"))}),
    least({_plus("a1", "4", "D")}, {_IS.format(_STAYS, "a", _plus("u", _CUT, "K"))}, CASE WHEN {_STAYS} THEN {_plus("u", _RENAMED, "R")} END)
  FROM ({_INSERTED.format("(SELECT r.*, f.fault, f.initial FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.place = r.t + 1)")})
), e AS (
  SELECT conv_id, substr(way, 9) AS audit, left(way, 8)::BIGINT AS cost FROM (SELECT conv_id, least(w, a1) AS way FROM ({_INSERTED.format("(SELECT r.* FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.t)")}))
), p AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS p FROM e
), q AS (
  SELECT *, sum((edit <> 'I')::INT) OVER w AS place, sum((edit <> 'D')::INT) OVER w AS q FROM p WHERE edit <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), g AS (
  SELECT q.*, f.role, f.text, max((edit = 'K' AND f.initial = 's')::INT) OVER (PARTITION BY q.conv_id) AS led
  FROM q LEFT JOIN f ON edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.place = q.place
), h AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
  FROM g WHERE edit <> 'D' GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""

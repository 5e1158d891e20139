"""Cheapest repair of the role sequence of conversations, by a suffix-shared DAWG.

A conversation becomes a signature: one symbol for each row with its role's initial and its fault.  Distinct
signatures are sorted from their ends, so signatures that end alike lie side by side, and each task builds the
automaton of its range from the end: a node is a suffix, and its cost-to-go and first edit for each grammar state are
computed once for all signatures that share it.  The best audit of a suffix is the first edit followed by the best
audit of the node that it leads to.

Conversations of any size: rows are dealt by range of conversation and turn, so a large conversation lies in several
parts.  Each part is a signature of its own; what the parts behind it cost for each grammar state is folded from the
four by four cost matrices of the parts, of which ranges cut at most two for each part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from passagework.operators.ordered import PART, dealt
from passagework.sources.scratch import save_scratch

#: Grammar states: nothing yet, after system, after user, after assistant; an end is legal in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that must follow in each state, and the state that it leads to.
WANTED = (("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER))
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE, DELETE, INSERT, OPEN = 2, 3, 2, 1
NEVER = 1 << 40
#: Symbol of a row that must be deleted; others are the initial (x: no legal one), in upper case if the row is truncated.
GONE = "d"
SPACES = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = ("su", "ua", "au")
#: Bytes of text that one row of repaired turns holds, a longer single turn aside.
CHUNK_BYTES = 1 << 20
PATHS = "array<struct<edits:string,cost:bigint,state:int>>"


class Suffix:
    """A node of the automaton: all rows from one on.  ``cost`` and ``step`` have an entry for each grammar state.

    A step is what is done first (K, D; U, A: other role; u, a: insertion; empty: end), the state that it leads to,
    and whether it goes on to the next row.
    """

    __slots__ = ("cost", "follows", "step")

    def __init__(self, symbol: str, follows: Suffix) -> None:
        self.follows, step = follows, []
        best = []
        extra = OPEN if symbol.isupper() else 0
        for state, (role, then) in enumerate(WANTED):
            ways = [(DELETE + follows.cost[state], "D", "D", state)]
            if symbol != GONE:
                ways.append((REROLE + extra + follows.cost[then], "R", role.upper(), then))
                if (kept := KEPT.get((state, symbol.lower()))) is not None:
                    ways.append((extra + follows.cost[kept], "K", "K", kept))
            best.append(min(ways))
        self.cost = with_insertions([cost for cost, *_ in best])
        for state, (role, then) in enumerate(WANTED):
            way = min(best[state], (INSERT + self.cost[then], "I", role, then))
            step.append((way[2], way[3], way[1] != "I"))
        self.step = step


class End(Suffix):
    """The node behind the last row; ``behind`` are the costs of what follows, or none where the conversation ends."""

    __slots__ = ()

    def __init__(self, behind: list[int] | None) -> None:
        self.follows = self
        stop = [0, NEVER, NEVER, 0] if behind is None else behind
        self.cost = with_insertions(stop) if behind is None else behind
        self.step = [("", state, False) if stop[state] <= self.cost[state] else (*WANTED[state], False) for state in range(4)]


def with_insertions(cost: list[int]) -> list[int]:
    """Costs where a state may also be left by inserting the role that it wants."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[then]) for c, (_, then) in zip(cost, WANTED, strict=True)]
    return cost


def best_edits(node: Suffix, state: int) -> tuple[str, int]:
    """Edits of the cheapest, and of those the least, audit from ``node`` on, and the state that it ends in."""
    edits = []
    while True:
        edit, state, moves = node.step[state]
        if not edit:
            return "".join(edits), state
        edits.append(edit)
        if moves:
            node = node.follows


def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths of signatures that come sorted by ``behind`` and their reversed symbols.

    ``nodes`` is the path of the automaton that leads to the signature before; what the next one shares with it stays.
    """
    nodes: list[Suffix] = []
    last, held = "", None
    for batch in batches:
        paths = []
        for turned, behind, starts in zip(batch["turned"], batch["behind"], batch["starts"], strict=True):
            if behind != held:
                nodes, last, held = [End([int(x) for x in behind.split(",")] if behind else None)], "", behind
            shared = len(os.path.commonprefix((last, turned)))
            del nodes[shared + 1 :]
            for symbol in turned[shared:]:
                nodes.append(Suffix(symbol, nodes[-1]))
            last, found = turned, []
            for state in range(starts):
                edits, end = best_edits(nodes[-1], state)
                found.append({"edits": edits, "cost": nodes[-1].cost[state] - nodes[0].cost[end], "state": end})
            paths.append(found)
        yield pd.DataFrame({"turned": batch["turned"], "behind": batch["behind"], "starts": batch["starts"], "paths": paths})


@F.arrow_udf(T.ArrayType(T.LongType()))
def _matrices(signatures: pa.Array) -> pa.Array:
    """Costs from each state before a part to each state behind it, row by row."""
    costs = []
    for turned in signatures.to_pylist():
        columns = []
        for end in range(4):
            node: Suffix = End([0 if s == end else NEVER for s in range(4)])
            for symbol in turned:
                node = Suffix(symbol, node)
            columns.append(node.cost)
        costs.append([min(columns[end][s], NEVER) for s in range(4) for end in range(4)])
    return pa.array(costs, pa.list_(pa.int64()))


def _behind(parts: pd.DataFrame) -> pd.DataFrame:
    """What follows each part of one conversation: costs for each state, the least taken as 0; empty for the last."""
    parts = parts.sort_values(PART, ascending=False)
    behind, out = End(None).cost, []
    for i, costs in enumerate(parts["costs"]):
        out.append(",".join(str(c - min(behind)) for c in behind) if i else "")
        behind = [min(costs[4 * s + end] + behind[end] for end in range(4)) for s in range(4)]
    return parts.drop(columns="costs").assign(behind=out)


def _entered(parts: pd.DataFrame) -> pd.DataFrame:
    """The state in which each part of one conversation begins."""
    parts = parts.sort_values(PART)
    state, out = START, []
    for ends in parts["ends"]:
        out.append(state)
        state = int(ends[state])
    return parts.drop(columns="ends").assign(entered=out)


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str, *, small: bool = False) -> DataFrame:
    """Join on keys of which any may be null; the right side has each key once."""
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    joined = left.join(F.broadcast(other) if small else other, on, how)
    return joined.drop(*(f"_{k}" for k in keys))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that crc32 of ``conv_id:turn`` modulo 20 gives; nulls are written as a space.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's.
    """
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(written[0], F.lit(":"), written[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    drawn = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault != 0")
    hurt = drawn.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")


@dataclass(frozen=True)
class Repair:
    """``conversations``: one row each with its faults, cost and audit.

    ``turns``: the repaired rows as ``conv_id, part, chunk, whole, turns``, where ``turns`` are (role, text) in order,
    ``part, chunk`` order the rows of a conversation, and ``whole`` tells that it has one row only.
    """

    conversations: DataFrame
    turns: DataFrame


def _signatures(rows: DataFrame) -> DataFrame:
    """Each part of each conversation with its reversed signature and counts, and how many parts its conversation has."""
    row = F.struct("turn", "_row")
    again = rows.groupBy("conv_id", "_digest").agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    seen = _same(rows.drop("text"), again, ("conv_id", "_digest"), "left")
    duplicate = F.coalesce(F.col("_first._row") != F.col("_row"), F.lit(False))
    fault = F.when(F.col("_blank"), "blank").when(duplicate, "duplicate").when(F.col("_open"), "truncated")
    letter = F.when(F.col("_initial").isin("s", "u", "a"), F.col("_initial")).otherwise("x")
    own = W.partitionBy(PART, "conv_id").orderBy("turn", "role", "_digest", "_row")
    placed = seen.select(
        PART, "conv_id", "turn", "_initial", fault.alias("_fault"), F.row_number().over(own).alias("_at"),
        F.lag("_initial").over(own).alias("_from"), F.lag("turn").over(own).alias("_since"), letter.alias("_letter"),
    )
    symbol = F.when(F.col("_fault").isin("blank", "duplicate"), GONE).when(F.col("_fault") == "truncated", F.upper("_letter")).otherwise(F.col("_letter"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    illegal = lambda before, after: before.isNotNull() & ~F.concat(before, after).isin(*LEGAL_PAIRS)
    parts = placed.withColumn("_symbol", symbol).groupBy(PART, "conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_symbol")), asc=False), lambda x: x["_symbol"]), "").alias("turned"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), count(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_since"))).alias("n_turns"),
        *(count(F.col("_fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(illegal(F.col("_from"), F.col("_initial"))).alias("illegal"),
        F.min_by("_initial", "_at").alias("_head"), F.max_by("_initial", "_at").alias("_tail"),
    )
    whole = W.partitionBy("conv_id").orderBy(PART)
    joint = parts.withColumns({
        "_tail_before": F.lag("_tail").over(whole), "_turn_before": F.lag("last_turn").over(whole),
        "n_parts": F.count(F.lit(1)).over(W.partitionBy("conv_id")), "nth": F.row_number().over(whole),
    })
    same_turn = F.coalesce(F.col("_turn_before") == F.col("first_turn"), F.lit(False)).cast("long")
    return joint.select(
        PART, "conv_id", "turned", "n_parts", "nth", "first_turn", "last_turn", (F.col("n_turns") - same_turn).alias("n_turns"), "blank", "duplicate", "truncated",
        (F.col("illegal") + illegal(F.col("_tail_before"), F.col("_head")).cast("long")).alias("illegal"),
    )


def _edits(parts: DataFrame) -> DataFrame:
    """``parts`` with the edits of each and their cost."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    costs = parts.where("n_parts > 1").select(PART, "conv_id", _matrices("turned").alias("costs"))
    behind = costs.groupBy("conv_id").applyInPandas(_behind, f"{PART} int, conv_id {kind}, behind string")
    tasks = _same(parts, save_scratch(behind, "behind"), (PART, "conv_id"), "left", small=True).withColumns(
        {"behind": F.coalesce("behind", F.lit("")), "starts": F.when(F.col("nth") == 1, 1).otherwise(4)}
    )
    keys = ["turned", "behind", "starts"]
    distinct = tasks.select(*keys).distinct().repartitionByRange("behind", "turned").sortWithinPartitions("behind", "turned")
    paths = distinct.mapInPandas(solved, f"turned string, behind string, starts int, paths {PATHS}")
    found = save_scratch(tasks.join(paths, keys), "edits")
    ends = found.where("n_parts > 1").select(PART, "conv_id", F.col("paths.state").alias("ends"))
    entered = ends.groupBy("conv_id").applyInPandas(_entered, f"{PART} int, conv_id {kind}, entered int")
    chosen = _same(found, save_scratch(entered, "entered"), (PART, "conv_id"), "left", small=True)
    path = F.when(F.size("paths") == 1, F.col("paths")[0]).otherwise(F.element_at("paths", F.col("entered") + 1))
    return chosen.withColumn("_path", path).select(*parts.columns, F.col("_path.edits").alias("edits"), F.col("_path.cost").alias("cost"))


def _repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows after the edits, in chunks of bounded bytes."""
    own = W.partitionBy(PART, "conv_id").orderBy("turn", "role", "_digest", "_row")
    size = F.octet_length("text") + F.octet_length("role") + 2
    placed = rows.select(
        PART, "conv_id", "role", "text", F.row_number().over(own).alias("_at"), F.floor(F.sum(size).over(own.rowsBetween(W.unboundedPreceding, 0)) / CHUNK_BYTES).alias("chunk"),
        (F.sum(size).over(W.partitionBy(PART, "conv_id")) < CHUNK_BYTES).alias("_small"),
    )
    chunks = placed.groupBy(PART, "conv_id", "chunk", "_small").agg(F.sort_array(F.collect_list(F.struct("_at", "role", "text"))).alias("_rows"))
    # the edits up to each row, and those behind the last
    steps = edits.select(PART, "conv_id", "n_parts", F.regexp_extract_all("edits", F.lit("[ua]*[KDUA](?:[ua]*$)?"), 0).alias("_steps"))
    both = _same(chunks, steps, (PART, "conv_id"), "inner")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    made = lambda e, row: (
        F.when(e == "K", turn(row["role"], row["text"])).when(e == "U", turn(F.lit("user"), row["text"])).when(e == "A", turn(F.lit("assistant"), row["text"]))
        .when(e == "u", turn(F.lit("user"), F.lit(""))).when(e == "a", turn(F.lit("assistant"), F.lit("")))
    )
    here = F.slice("_steps", F.col("_rows")[0]["_at"], F.size("_rows"))
    per_row = F.zip_with("_rows", here, lambda row, step: F.filter(F.transform(F.split(step, ""), lambda e: made(e, row)), lambda t: t.isNotNull()))
    return both.select("conv_id", F.col(PART).alias("part"), "chunk", (F.col("_small") & (F.col("n_parts") == 1)).alias("whole"), F.flatten(per_row).alias("turns"))


def repair_conversations(rows: DataFrame) -> Repair:
    """Faults and cheapest repair of conversations ``conv_id, turn, role, text``.

    Rows are taken by turn, nulls first; rows of one turn follow by role and a hash of role and text, so equal ones stand side by
    side.  A row's first fault counts: blank, duplicate (role and text came before), truncated (doesn't end with
    ``.``, ``!`` or ``?``).  The repair makes role initials fit ``(s?(ua)+)?``: keeping a row costs nothing, giving it
    the role user or assistant 2, deleting it 3 (blank and duplicate rows must be), inserting an empty turn of user or
    assistant 2, and a truncated row that isn't deleted 1.  Of the cheapest repairs the one with the least audit
    (initials of Delete, Insert, Keep, Rerole) is taken.

    ``conversations`` has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` (``edits`` with the
    roles besides: U and A for a new role, u and a for an inserted turn).  A null ``conv_id`` is a conversation like
    others; null roles and texts are taken as one space; a role whose initial isn't s, u or a (an empty one has none) never fits.
    Conversations without rows have no result; an empty table gives empty tables; extra columns are left out.
    A conversation may hold any share of the rows; its audit is one string.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    taken = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    ended = F.rtrim("text", F.lit(SPACES))
    marked = taken.withColumns({
        "_digest": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")),
        "_initial": F.substring("role", 1, 1), "_blank": ended == "", "_open": ~F.substring(ended, -1, 1).isin(".", "!", "?"), "_row": F.monotonically_increasing_id(),
    })
    placed = dealt(marked, ["conv_id"], ["turn", "role", "_digest", "_row"])
    parts = save_scratch(_signatures(placed), "signatures")
    edits = save_scratch(_edits(parts), "repairs")
    per_part = F.sort_array(F.collect_list(F.struct(PART, "edits")))
    known = edits.groupBy("conv_id").agg(
        (F.max("last_turn") - F.min("first_turn") + 1 - F.sum("n_turns")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(per_part, lambda x: x["edits"]), "").alias("edits"),
    )
    gaps, audit = F.coalesce(F.col("gaps").cast("long"), F.lit(0)), F.translate("edits", "UAua", "RRII")
    return Repair(known.withColumns({"gaps": gaps, "audit": audit}), _repaired(placed, edits))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of conversations whose chunks come one after another."""
    digest, last, lines = None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv_id, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n")), strict=True):
            if digest is None or conv_id != last:
                if digest is not None:
                    yield done()
                digest, last, lines = hashlib.sha256(), conv_id, 0
            digest.update(("\n" if lines and n else "").encode() + text.encode())
            lines += n
    if digest is not None:
        yield done()


def turns_sha256(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of ``role:text`` of a conversation's turns, joined by line feeds.

    A digest goes through its bytes in order, so the chunks of a conversation that has several stream through one
    task, which holds a batch of them.
    """
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    texts = turns.select("conv_id", "part", "chunk", "whole", F.array_join(F.transform("turns", line), "\n").alias("text"), F.size("turns").alias("n"))
    one = texts.where("whole").select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("repaired_sha256"))
    several = texts.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").select("conv_id", "text", "n")
    return one.unionByName(several.mapInArrow(_streamed, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"))

"""Conversation structure repair by Hirschberg's divide and conquer over four-state cost vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed

BLOCK_BITS = 11  # 2,048 items are a block, solved in one task
FAN = 4096  # pieces of one conversation that one task may join
INF = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"

# What a repaired prefix ends with: nothing, system, user, assistant. A conversation may end in the first or the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)  # what an inserted or renamed row becomes after each state
CLOSING = (0, 2, 1, 0)  # rows to insert at the end
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
FINE, CUT, GONE = range(3)  # a row without fault; one that costs 1 if it stays; one that must be deleted
OTHER = 4  # initial of a role that no state takes
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


# --- four-state vectors -----------------------------------------------------------------------------


def _steps(initial: int, fault: int) -> list[list[tuple[int, str] | None]]:
    """[p][q]: cost and edits (inserts, then that of the row) of the cheapest way from p to q, ties by the edits."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        state = p
        for inserted in range(3):  # a third insert leads to where the first one does
            ways = [("D", state)]
            if fault != GONE:
                ways.append(("R", AFTER[state]))
                if (initial == SYSTEM and state == EMPTY) or (initial in (USER, ASSISTANT) and AFTER[state] == initial):
                    ways.append(("K", initial))
            for edit, q in ways:
                way = 2 * inserted + COST[edit] + (fault == CUT and edit != "D"), "I" * inserted + edit
                table[p][q] = min(table[p][q] or way, way)
            state = AFTER[state]
    return table


def _transfer(table: list[list[tuple[int, str] | None]]) -> tuple:
    """Costs [p][q], and for each p the order of the edits that lead to the states q."""
    ranks = []
    for row in table:
        order = sorted((way[1], q) for q, way in enumerate(row) if way)
        place = {q: i for i, (_, q) in enumerate(order)}
        ranks.append(tuple(place.get(q, 4) for q in range(4)))
    return tuple(tuple(way[0] if way else INF for way in row) for row in table), tuple(ranks)


STEPS = {4 * fault + initial - 1: _steps(initial, fault) for fault in range(3) for initial in (SYSTEM, USER, ASSISTANT, OTHER)}
TRANSFERS = {kind: _transfer(table) for kind, table in STEPS.items()}


def unit(state: int) -> tuple:
    return tuple(0 if q == state else INF for q in range(4)), (0, 0, 0, 0)


@lru_cache(1 << 16)
def forward(vector: tuple, transfer: tuple) -> tuple[int, tuple]:
    """One item on: what the least cost rose by, and the vector of (costs above the least, order of the edits so far).

    Edits that end with the edit of a row and hold equally many of them are no prefixes of each other, so those of a
    longer conversation compare as their beginnings do: an order of at most four numbers stands for the edits.
    """
    (cost, rank), (step, order) = vector, transfer
    found = [min((cost[m] + step[m][q], rank[m], order[m][q]) for m in range(4)) for q in range(4)]
    least = min(c for c, _, _ in found)
    place = {key: i for i, key in enumerate(sorted({(r, o) for c, r, o in found if c < INF}))}
    return least, (tuple(c - least if c < INF else INF for c, _, _ in found), tuple(place.get((r, o), 4) for _, r, o in found))


@lru_cache(1 << 16)
def backward(costs: tuple, transfer: tuple) -> tuple:
    """One item back: least further cost from each state, above the least of the four."""
    found = [min(transfer[0][p][q] + costs[q] for q in range(4)) for p in range(4)]
    least = min(found)
    return tuple(c - least if c < INF else INF for c in found)


def last_state(transfers: list[tuple], start: int) -> int:
    """The state after all items in the cheapest repair, ties by the least edits."""
    vector = unit(start)
    for transfer in transfers:
        vector = forward(vector, transfer)[1]
    return min(range(4), key=lambda q: (vector[0][q] + 2 * CLOSING[q], vector[1][q]))


def crossings(transfers: list[tuple], start: int, end: int) -> list[int]:
    """The states before, between and after the items in the cheapest way from ``start`` to ``end``, ties by the least edits.

    Hirschberg's scheme: the forward vector of the first half meets the backward vector of the second; of the cheapest
    crossings the one whose edits so far are least is taken, and both halves go on by themselves. No more than the
    two vectors is held at a time.
    """
    states = [start] * len(transfers) + [end]
    open_ = [(0, len(transfers))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        mid = (low + high) // 2
        vector = unit(states[low])
        for transfer in transfers[low:mid]:
            vector = forward(vector, transfer)[1]
        costs = unit(states[high])[0]
        for transfer in reversed(transfers[mid:high]):
            costs = backward(costs, transfer)
        states[mid] = min(range(4), key=lambda m: (vector[0][m] + costs[m], vector[1][m]))
        open_ += [(low, mid), (mid, high)]
    return states


def joined(transfers: list[tuple]) -> tuple:
    """The items of one piece as one item."""
    costs, ranks = [], []
    for start in range(4):
        vector, base = unit(start), 0
        for transfer in transfers:
            rise, vector = forward(vector, transfer)
            base += rise
        costs.append(tuple(c + base if c < INF else INF for c in vector[0]))
        ranks.append(vector[1])
    return tuple(costs), tuple(ranks)


# --- items of many conversations ----------------------------------------------------------------------

ITEM = "conv string, at long, costs array<long>, ranks array<int>, tail int"
STATE = "at long, entry int, exit int, prior int, final boolean"


def _read(table: pa.Table) -> tuple[list, list, list, list]:
    """conv, at, transfer and last initial of each item, in order of ``at``."""
    table = table.sort_by("at")
    conv, at = table.column("conv").to_pylist(), table.column("at").to_pylist()
    if "kind" in table.column_names:
        kinds = table.column("kind").to_pylist()
        return conv, at, [TRANSFERS[k] for k in kinds], [k % 4 + 1 for k in kinds]
    four = lambda flat: tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4))
    transfers = [(four(c), four(r)) for c, r in zip(table.column("costs").to_pylist(), table.column("ranks").to_pylist())]
    return conv, at, transfers, table.column("tail").to_pylist()


def _pieces(conv: list) -> list[tuple[int, int]]:
    """Ranges of items of one conversation."""
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return list(zip(cuts, cuts[1:]))


def _ends(table: pa.Table) -> pa.Table:
    """The first and the last piece of a block as one item each: only they can go on in another block."""
    conv, at, transfers, tails = _read(table)
    pieces = _pieces(conv)
    rows = []
    for low, high in {pieces[0], pieces[-1]}:
        costs, ranks = joined(transfers[low:high])
        rows.append((conv[low], at[low], sum(costs, ()), sum(ranks, ()), tails[high - 1]))
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("conv", "at", "costs", "ranks", "tail"), zip(*rows), kinds)})


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("at", "entry", "exit", "prior", "final"), columns, kinds)})


def _walk(at: list, transfers: list, tails: list, low: int, high: int, entry: int, end: int | None, prior: int, final: bool) -> Iterator[tuple]:
    """(at, entry, exit, prior, final) of the items of one piece; ``prior`` is the initial before an item, 0 if none."""
    states = crossings(transfers[low:high], entry, last_state(transfers[low:high], entry) if end is None else end)
    for i in range(low, high):
        yield at[i], states[i - low], states[i - low + 1], prior, final and i == high - 1
        prior = tails[i]


def _whole(table: pa.Table) -> pa.Table:
    """All pieces of one conversation."""
    _, at, transfers, tails = _read(table)
    return _found(list(_walk(at, transfers, tails, 0, len(at), EMPTY, None, 0, True)))


def _inside(table: pa.Table, given: pa.Table) -> pa.Table:
    """The items of a block: conversations between its first and its last are whole, those two got their states from above."""
    if not table.num_rows:
        return _found([])
    conv, at, transfers, tails = _read(table)
    known = {r["at"]: (r["entry"], r["exit"], r["prior"], r["final"]) for r in given.to_pylist()}
    rows = []
    for low, high in _pieces(conv):
        rows += _walk(at, transfers, tails, low, high, *known.get(at[low], (EMPTY, None, 0, True)))
    return _found(rows)


def _states(items: DataFrame) -> DataFrame:
    """``STATE`` of each item (``ITEM`` columns or kind; ``at`` grows along a conversation, whose items are contiguous by it).

    Blocks of 2,048 items are solved in tasks of their own; their first and last conversations, which may go on in other
    blocks, become items of a next, about thousandfold smaller table, until no conversation has more than ``FAN``.
    """
    blocked = items.withColumn("block", F.shiftright("at", BLOCK_BITS))
    ends = checkpointed(blocked.groupBy("block").applyInArrow(_ends, ITEM))
    size = ends.groupBy("conv").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    if (size["most"] or 0) <= FAN:
        states = ends.groupBy("conv").applyInArrow(_whole, STATE)
    else:
        again = ends.repartitionByRange(max(size["n"] >> (BLOCK_BITS + 4), 1), "conv", "at").sortWithinPartitions("conv", "at")
        again = checkpointed(again.withColumnRenamed("at", "under").withColumn("at", F.monotonically_increasing_id()))
        above = _states(again.drop("under")).join(again.select("at", "under"), "at").drop("at")
        states = above.withColumnRenamed("under", "at")
    given = checkpointed(states).withColumn("block", F.shiftright("at", BLOCK_BITS))
    return checkpointed(blocked.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_inside, STATE))


# --- tables ---------------------------------------------------------------------------------------------


@dataclass
class Repair:
    """``runs``: one row per run of equal rows with its edit; ``counts``: one row per conversation that has rows."""

    runs: DataFrame
    counts: DataFrame


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def repair(turns: DataFrame) -> Repair:
    """Cheapest edits that make the initials of the roles of each conversation ``(s?(ua)+)?``, ties by the least edits.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Rows of a conversation stand by turn (null
    first), then role and text; a null role or text is one blank; a null conv_id is a conversation. The first fault of a
    row counts: blank, duplicate (role and text seen earlier), truncated (last character that is no blank not one of
    ``.!?``). Keep costs 0, Rerole (to user or assistant) 2, Delete 3 and is needed for blank and duplicate rows, Insert
    (of an empty user or assistant row) 2; a truncated row that stays costs 1. An empty table gives empty tables.

    Equal rows of one turn are one row of ``runs`` with their number, so a hot group of copies is a sum. Texts stay in
    the JVM; only the kind of a row, one of twelve, reaches the four-state vectors. A conversation of any length is
    cut at block borders, and its pieces meet as 4 x 4 cost tables. Very long texts are digested once, for equality.

    runs: conv (conv_id as a string, null empty), conv_id, at (order), turn, role, text, copies, inserted (rows before
    it), first (K, R or D, of the first copy; further copies are deleted), entry and exit (states before and after), final
    (last of its conversation). counts: conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumns({"conv": _key("conv_id"), "place": _key("turn"), "said": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)})
    keys = ["conv", "place", "said"]
    same = rows.groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in ("conv_id", "turn", "role", "text")), F.count(F.lit(1)).alias("copies"))
    # the first turn that says it; equal rows of that turn are one row here
    early = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place")).alias("e")
    firsts = rows.groupBy("conv", "said").agg(early).select("conv", F.col("e.place").alias("place"), "said", F.lit(True).alias("new"))
    bare = F.rtrim("text", F.lit(BLANKS))
    kind = F.when((bare == "") | F.col("new").isNull(), GONE).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    flagged = same.join(firsts, keys, "left").select(
        "conv", "conv_id", "turn", "role", "text", "copies",
        (bare == "").alias("blank"), F.col("new").isNotNull().alias("new"), (4 * kind + initial - 1).alias("kind"),
    )
    order = ["conv", "turn", "role", "text"]
    placed = checkpointed(flagged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    states = _states(placed.select("conv", "at", "kind"))
    edits = F.array(*(F.array(*(F.lit(way[1] if way else None) for row in STEPS[k] for way in row)) for k in range(len(STEPS))))
    runs = placed.join(states, "at").withColumn("edits", edits[F.col("kind")][F.col("entry") * 4 + F.col("exit")])
    illegal = F.col("copies") - 1
    pair = F.array(*(F.lit(10 * a + b) for a, b in sorted(LEGAL)))
    illegal += ((F.col("prior") > 0) & ~F.array_contains(pair, 10 * F.col("prior") + F.col("kind") % 4 + 1)).cast("long")
    first, inserted = F.substring("edits", -1, 1), (F.length("edits") - 1).alias("inserted")
    cut = (F.floor(F.col("kind") / 4) == CUT).cast("long")
    spent = F.when(first == "D", 3).when(first == "R", 2 + cut).otherwise(cut) + 2 * (F.length("edits") - 1) + 3 * (F.col("copies") - 1)
    closing = F.when(F.col("final"), F.array(*map(F.lit, CLOSING))[F.col("exit")]).otherwise(0)
    runs = runs.withColumns({"inserted": inserted, "first": first, "illegal": illegal, "closing": closing, "cost": spent + 2 * closing, "cut": cut})
    known = ~F.col("blank")
    counts = runs.groupBy("conv").agg(
        F.any_value("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(~known, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(known, F.col("copies") - F.col("new").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum("cut").alias("truncated"),
        F.sum("illegal").alias("illegal"),
        F.sum("cost").cast("long").alias("cost"),
    )
    return Repair(checkpointed(runs.drop("edits", "prior")), counts)


def _named(state: Column, n: int) -> Column:
    """Roles of ``n`` rows that follow a state by inserting or renaming."""
    pair = ["assistant", "user"]
    lists = [F.array(*(F.lit(pair[(i + lead) % 2]) for i in range(n))) for lead in (0, 1)]
    return F.when(state == USER, lists[0]).otherwise(lists[1])


def repaired_turns(fixed: Repair) -> DataFrame:
    """conv_id, at, part, edit (K, R or I), role, text: the rows of the repaired conversations in order of (at, part)."""
    names, row = _named(F.col("entry"), 3), lambda e, r, t: F.struct(e.alias("edit"), r.alias("role"), t.alias("text"))
    blank, none = F.lit(""), F.array().cast("array<struct<edit:string,role:string,text:string>>")
    added = lambda roles: F.transform(roles, lambda r: row(F.lit("I"), r, blank))
    own = F.array(row(F.col("first"), F.when(F.col("first") == "R", names[F.col("inserted")]).otherwise(F.col("role")), F.col("text")))
    parts = F.concat(
        added(F.slice(names, F.lit(1), F.col("inserted"))),
        F.when(F.col("first") == "D", none).otherwise(own),
        added(F.slice(_named(F.col("exit"), 2), F.lit(1), F.col("closing"))),
    )
    return fixed.runs.select("conv", "conv_id", "at", F.posexplode(parts).alias("part", "row")).select("conv", "conv_id", "at", "part", "row.*")


def digests(fixed: Repair) -> DataFrame:
    """conv, audit (initials of all edits in order), repaired_sha256 (``role:text`` by line) of each conversation.

    A digest is a walk in order, so the rows of a conversation pass through one task, one after the other; only the
    audit is held.
    """
    audit = F.concat(F.repeat(F.lit("I"), F.col("inserted")), F.col("first"), F.expr("repeat('D', int(copies) - 1)"), F.repeat(F.lit("I"), F.col("closing")))
    marks = fixed.runs.select("conv", "at", F.lit(-1).alias("part"), audit.alias("audit"), F.lit(None).cast("string").alias("line"))
    lines = repaired_turns(fixed).select("conv", "at", "part", F.lit("").alias("audit"), F.concat("role", F.lit(":"), "text").alias("line"))
    order = ["conv", "at", "part"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, begun = None, [], None, False
        row = lambda: pa.RecordBatch.from_pydict({"conv": [conv], "audit": ["".join(audit)], "repaired_sha256": [sha.hexdigest()]})
        for batch in batches:
            for key, piece, line in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "line"))):
                if key != conv:
                    if sha is not None:
                        yield row()
                    conv, audit, sha, begun = key, [], hashlib.sha256(), False
                audit.append(piece)
                if line is not None:
                    sha.update((("\n" if begun else "") + line).encode())
                    begun = True
        if sha is not None:
            yield row()

    passed = marks.unionByName(lines).repartition("conv").sortWithinPartitions(*order)
    return passed.mapInArrow(work, "conv string, audit string, repaired_sha256 string")


def report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without rows in ``turns`` has zeros, an empty audit and the digest of an empty text.
    """
    fixed = repair(turns)
    ids = conversations.select("conv_id").distinct().withColumn("conv", _key("conv_id"))
    found = ids.join(fixed.counts.drop("conv_id"), "conv", "left").join(digests(fixed), "conv", "left")
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

"""Chat formatting: minimum-cost repair of the roles of a conversation, then rendering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.session import materialise

ROLES = ("system", "user", "assistant")
#: States of the automaton: nothing yet, or the role of the last message.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles that may follow in each state; a conversation ends after the assistant.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of a new label (known, unknown role), of joining the message before (same, other, unknown role) and of an empty message.
RELABEL, NAME, MERGE, MERGE_OTHER, MERGE_UNKNOWN, INSERT = 2, 1, 1, 3, 2, 3
#: Turns of a conversation that are solved together; longer ones are cut and their pieces composed.
FRAGMENT = 1024
FAR = 1 << 40

ACTIONS = ("keep", "relabel", "merge", "insert", "insert_relabel")


def moves(state: int, role: int) -> list[tuple[int, int, str, int, int]]:
    """(cost, next state, action, role given, role of an empty message before it or 0) of a turn, cheapest kinds first."""
    out = []
    for new in LEGAL[state]:
        out.append((0, new, "keep", new, 0) if new == role else (RELABEL if role else NAME, new, "relabel", new, 0))
    if state:
        out.append((MERGE if role == state else MERGE_OTHER if role else MERGE_UNKNOWN, state, "merge", state, 0))
    for between in LEGAL[state]:
        for new in LEGAL[between]:
            if new == role:
                out.append((INSERT, new, "insert", new, between))
            else:
                out.append((INSERT + (RELABEL if role else NAME), new, "insert_relabel", new, between))
    return sorted(out)


_MOVES = {(s, r): moves(s, r) for s in range(4) for r in range(4)}


def ending(state: int) -> list[int]:
    """Roles of the empty messages that close a conversation in a state."""
    return {START: [USER, ASSISTANT], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}[state]


@lru_cache(maxsize=1 << 16)
def _step(role: int, ahead: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """One turn back: (shift, costs from each state to each exit less the shift, index of the first of the cheapest moves)."""
    now, first = [FAR] * 16, [-1] * 16
    for state in range(4):
        for i, move in enumerate(_MOVES[state, role]):
            for final in range(4):
                rest = ahead[4 * move[1] + final]
                if rest < FAR and move[0] + rest < now[4 * state + final]:
                    now[4 * state + final], first[4 * state + final] = move[0] + rest, i
    shift = min(now)
    return shift, tuple(c - shift if c < FAR else FAR for c in now), tuple(first)


def solve(roles: list[int]) -> tuple[list[list[int]], dict[tuple[int, int], list[tuple[int, int, str, int, int]]], list[list[int]]]:
    """Least costs from each state to each over some turns, the moves of each such way and its rank; roles are 1 to 3, 0 unknown.

    Dynamic programming over the automaton's states, from the last turn back. Of equally cheap ways the first in order is taken:
    that whose first turn has the earlier move, then whose second, and so on. Ranks are the order of the ways from one state. So
    the way through several runs of turns follows from their tables alone and is the same wherever a conversation is cut.
    """
    ahead, total, firsts = tuple(0 if s == f else FAR for s in range(4) for f in range(4)), 0, []
    for role in reversed(roles):
        shift, ahead, first = _step(role, ahead)
        total += shift
        firsts.append((role, first))
    firsts.reverse()
    costs, ways, ranks = [[FAR] * 4 for _ in range(4)], {}, [[0] * 4 for _ in range(4)]
    for entry in range(4):
        order = []
        for final in range(4):
            if ahead[4 * entry + final] >= FAR:
                continue
            costs[entry][final] = ahead[4 * entry + final] + total
            state, way, places = entry, [], []
            for role, first in firsts:
                places.append(first[4 * state + final])
                way.append(_MOVES[state, role][places[-1]])
                state = way[-1][1]
            ways[entry, final] = way
            order.append((places, final))
        for rank, (_, final) in enumerate(sorted(order)):
            ranks[entry][final] = rank
    return costs, ways, ranks


def close(costs: list[list[int]], entry: int = START) -> tuple[int, int]:
    """The cheapest (cost with the ending, final state) from a state."""
    return min((costs[entry][s] + INSERT * len(ending(s)), s) for s in range(4))


def compose(fragments: list[list[list[int]]], ranks: list[list[list[int]]] | None = None) -> list[tuple[int, int]]:
    """Entry and exit state of each fragment on the cheapest way through all; of equally cheap exits the one of the least rank."""
    ahead = [[INSERT * len(ending(s)) for s in range(4)]]
    for costs in reversed(fragments):
        ahead.append([min(costs[s][t] + ahead[-1][t] for t in range(4)) for s in range(4)])
    out, state = [], START
    for i, costs in enumerate(fragments):
        rest, rank = ahead[len(fragments) - 1 - i], ranks[i][state] if ranks else range(4)
        exit_ = min(range(4), key=lambda t: (costs[state][t] + rest[t], rank[t]))  # noqa: B023
        out.append((state, exit_))
        state = exit_
    return out


def repair(conversations: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """One row per row of conversations (conv_id, turn, role, text), with what the cheapest legal conversation makes of it.

    Returns conv_id, turn, role, ordinal (place in the conversation, from 0), action, new_role, message (index of the message
    that the turn is in), inserted (roles of empty messages before, and after the last turn), piece (its part of the
    rendering) and cost (of its action, insertions and, at the last turn, the ending). Pieces in order of ordinal are the rendered conversation.

    Legal is an optional system message, then user and assistant in turn, ending with the assistant. Turns are sorted
    globally by (conv_id, turn, role, text); each task solves runs of up to `fragment` turns of a conversation for all four
    entry states, and conversations of several fragments are composed from these 4 x 4 tables, one small row for each run. So no
    conversation's turns are ever gathered, however many, and neither `fragment` nor the partitions change a result: of equally cheap ways the
    first in order of moves is taken (see solve()). Roles are trimmed and lower-cased; null and other roles are unknown. Null text is empty. Turns of a null conv_id are one
    conversation. Null turns come first; equal turns are ordered by role and text. Empty input: empty result. Extra columns are left out.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    tied = conversations.select("conv_id", "turn", "role", "text").withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    ordered = tied.repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys, "tie").drop("tie").withColumn("part", F.spark_partition_id())
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("fragment", pa.int64()), ("at", pa.int32()), ("ways", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("turns", pa.int32())])
    names = {name: i + 1 for i, name in enumerate(ROLES)}

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            costs, ways, ranks = solve([names.get((r[2] or "").strip().lower(), 0) for r in held])
            codes: list[list[int]] = [[-1] * 16 for _ in held]
            counts = [0] * 16
            for (entry, final), way in ways.items():
                n = 0
                for i, (cost, _, action, new, before) in enumerate(way):
                    n += (action != "merge") + (before > 0)
                    codes[i][4 * entry + final] = (((n * 8 + ACTIONS.index(action)) * 4 + new) * 4 + before) * 16 + cost
                counts[4 * entry + final] = n
            rows = [(*r, number, i, codes[i], None, None, None, None) for i, r in enumerate(held)]
            conv, part = held[0][0], held[0][4]
            rows.append((conv, None, None, None, part, number, None, None, [c for row in costs for c in row], [c for row in ranks for c in row], counts, len(held)))
            held.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "part")), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= fragment):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    everything = materialise(ordered.mapInArrow(solved, "conv_id long, turn long, role string, text string, part int, fragment long, at int, ways array<int>, costs array<long>, ranks array<int>, counts array<int>, turns int"), "roles")
    fragments = everything.where("at IS NULL").select("conv_id", "part", "fragment", "costs", "ranks", "counts", "turns")
    several = fragments.groupBy("conv_id").agg(F.count("*").alias("fragments")).withColumnRenamed("conv_id", "of_conv")
    counted = materialise(fragments.join(several, F.col("conv_id").eqNullSafe(F.col("of_conv"))).drop("of_conv"), "role-fragments")

    def composed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("fragment", "ascending")])
        costs, ranks = ([[c[4 * s : 4 * s + 4] for s in range(4)] for c in table.column(name).to_pylist()] for name in ("costs", "ranks"))
        ways, before, messages, offsets, firsts = compose(costs, ranks), 0, 0, [], []
        for (entry, final), turns, counts in zip(ways, table.column("turns").to_pylist(), table.column("counts").to_pylist(), strict=True):
            offsets.append(before)
            firsts.append(messages)
            before, messages = before + turns, messages + counts[4 * entry + final]
        size = len(ways)
        return pa.table({"part": table.column("part"), "fragment": table.column("fragment"), "way": pa.array([4 * a + b for a, b in ways], pa.int32()), "offset": pa.array(offsets, pa.int64()), "first": pa.array(firsts, pa.int64()), "closes": pa.array([i == size - 1 for i in range(size)]), "turns": table.column("turns")})

    path = "part int, fragment long, way int, offset long, first long, closes boolean, turns int"
    long = counted.where("fragments > 1").groupBy("conv_id").applyInArrow(composed, path)
    exits = F.array(*[F.struct((F.get("costs", F.lit(s)) + INSERT * len(ending(s))).alias("cost"), F.get("ranks", F.lit(s)).alias("rank"), F.lit(s).alias("state")) for s in range(4)])
    short = counted.where("fragments = 1").select("part", "fragment", F.array_min(exits)["state"].alias("way"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("first"), F.lit(True).alias("closes"), "turns")
    paths = materialise(long.unionByName(short), "role-paths")

    placed = everything.where("at IS NOT NULL").drop("costs", "ranks", "counts", "turns").join(paths, ["part", "fragment"])
    code = F.get("ways", F.col("way"))
    name = lambda n: F.get(F.array(F.lit(None).cast("string"), *map(F.lit, ROLES)), n)
    turn = placed.withColumn("code", code).select(
        "conv_id", "turn", "role", "text", (F.col("offset") + F.col("at")).alias("ordinal"),
        F.get(F.array(*map(F.lit, ACTIONS)), F.expr("shiftright(code, 8) & 7")).alias("action"),
        name(F.expr("shiftright(code, 6) & 3")).alias("new_role"), name(F.expr("shiftright(code, 4) & 3")).alias("before"), F.expr("code & 15").alias("move_cost"),
        (F.col("first") + F.expr("shiftright(code, 11)") - 1).alias("message"), (F.col("closes") & (F.col("at") == F.col("turns") - 1)).alias("last"), F.expr("way & 3").alias("state"),
    )
    tail = F.when(F.col("last"), F.get(F.array(*[F.array(*[F.lit(ROLES[r - 1]) for r in ending(s)]).cast("array<string>") for s in range(4)]), F.col("state"))).otherwise(F.array().cast("array<string>"))
    opened = lambda role: F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
    over = F.lit("<|im_end|>\n")
    text = F.coalesce(F.col("text"), F.lit(""))
    begins = F.concat(F.when(F.col("ordinal") > 0, over).otherwise(""), F.when(F.col("before").isNotNull(), F.concat(opened(F.col("before")), over)).otherwise(""), opened(F.col("new_role")), text)
    piece = F.concat(F.when(F.col("action") == "merge", F.concat(F.lit("\n\n"), text)).otherwise(begins), F.when(F.col("last"), F.concat(over, F.concat_ws("", F.transform("tail", lambda r: F.concat(opened(r), over))))).otherwise(""))
    full = turn.withColumn("tail", tail)
    return full.select(
        "conv_id", "turn", "role", "ordinal", "action", "new_role", "message", F.concat(F.array_compact(F.array("before")), F.col("tail")).alias("inserted"), piece.alias("piece"), (F.col("move_cost") + INSERT * F.size("tail")).cast("long").alias("cost")
    )


def rendered(repaired: DataFrame) -> DataFrame:
    """conv_id, cost and the whole rendered text of each conversation; for conversations that fit in a task's memory."""
    pieces = F.sort_array(F.collect_list(F.struct("ordinal", "piece")))
    return repaired.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("rendered"))

"""A Merkle tree over every group of a dataset and over the groups' roots, with proofs by lookup of coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.llm.feistel import row_numbers
from lathe.session import materialise

#: Nodes that become one, and levels that one pass builds or proves: it gathers ARITY ** LAYER nodes, so a bounded number, in a group.
ARITY, LAYER = 3, 4
SPAN = ARITY**LAYER
#: What a leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value so that no two lists of values read alike: `-` for null, else its bytes' number, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _hash(digests: str) -> str:
    """SQL for the binary digest of an array of binary digests, which are concatenated as hex text."""
    return f"unhex(sha2(array_join(transform({digests}, b -> lower(hex(b))), ''), 256))"


@dataclass
class Manifest:
    """leaves: gid, n, idx, info (struct); nodes: gid, level, n, idx, digest, n being the nodes of that level in the group; groups: gid, the group's column, n."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    largest: int


def place(leaves: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """leaves with gid, n and idx in its group by `order`, nulls first; and the groups (gid, group, n), numbered in their order, null first.

    Rows are sorted by ranges over all groups, so that a group of a third of all rows is many ranges; a group's share of a range is
    contiguous, and running sums over (group, range), one row each, give its rows their places. No window is over rows.
    """
    keys = [group, *order]
    sort = [F.col(k).asc_nulls_first() for k in keys]
    spread = leaves.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    placed = spread.repartitionByRange(*sort, F.col("tie")).sortWithinPartitions(*sort, "tie").drop("tie")
    placed = materialise(placed.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves").withColumn("part", F.shiftright("at", 33))
    runs = materialise(placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")), "merkle-runs")
    groups = row_numbers(runs.groupBy(group).agg(F.sum("rows").alias("n")), [group], "gid")
    before = W.Window.partitionBy(group).orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    starts = runs.select(F.col(group).alias("_group"), F.col("part").alias("_part"), shift.alias("shift"))
    starts = starts.join(groups, F.col("_group").eqNullSafe(F.col(group))).select("_group", "_part", "shift", "gid", "n")
    starts = materialise(starts, "merkle-starts")
    member = placed.join(starts, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return member.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "_part", "_group", "shift"), groups


def grow(base: DataFrame, largest: int) -> DataFrame:
    """All nodes (gid, level, n, idx, digest) over the leaves `base` (the same with level 0), of which no group has more than largest.

    Each pass gathers blocks of SPAN neighbours and makes LAYER levels of them at once, so there are log(largest) / log(SPAN) passes over ever
    smaller tables; each is written.
    """
    tables, below, level = [base], base, 0
    while largest > 1:
        blocks = below.where("n > 1").groupBy("gid", "n", F.expr(f"idx div {SPAN}").alias("block"))
        made = blocks.agg(F.expr("transform(array_sort(collect_list(struct(idx, digest))), x -> x.digest)").alias("a0"))
        for j in range(1, LAYER + 1):
            runs = f"transform(sequence(0, (size(a{j - 1}) - 1) div {ARITY}), i -> {_hash(f'slice(a{j - 1}, i * {ARITY} + 1, {ARITY})')})"
            made = made.withColumn(f"a{j}", F.expr(f"CASE WHEN n > {ARITY ** (j - 1)} THEN {runs} END"))
        node = "struct({level} AS level, (n + {wide} - 1) div {wide} AS n, block * {held} + i AS idx, d AS digest)"
        per_level = [f"transform(a{j}, (d, i) -> {node.format(level=level + j, wide=ARITY**j, held=ARITY ** (LAYER - j))})" for j in range(1, LAYER + 1)]
        made = made.select("gid", F.explode(F.expr(f"flatten(array_compact(array({', '.join(per_level)})))")).alias("x")).select("gid", "x.*")
        tables.append(materialise(made.select(*_typed()), "merkle-nodes"))
        level, largest = level + LAYER, -(-largest // SPAN)
        below = tables[-1].where(F.col("level") == level)
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _typed() -> list[Column]:
    return [F.col(c).cast(t) for c, t in (("gid", "long"), ("level", "int"), ("n", "long"), ("idx", "long"), ("digest", "binary"))]


def build(leaves: DataFrame, group: str, order: Sequence[str], info: Sequence[str]) -> Manifest:
    """The tree of each group over leaves (group, columns of order and info, leaf as hex text), ordered by `order`, null first.

    While a level has several nodes, every ARITY consecutive ones (the last run may be shorter, even one) become the hash of their joined hex text.
    """
    placed, groups = place(leaves, group, order)
    member = materialise(placed.select("gid", "n", "idx", F.struct(*info).alias("info"), F.unhex("leaf").alias("digest")), "merkle-members")
    base = member.withColumn("level", F.lit(0)).select(*_typed())
    largest = groups.agg(F.max("n")).first()[0] or 0
    return Manifest(member.drop("digest"), grow(base, largest), groups, largest)


def _climb(members: DataFrame, nodes: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """members (gid, n, idx, info) of a level with the path from it: the siblings' hex text before and after, a level each, then above's path.

    Each member explodes the coordinates of its siblings on LAYER levels, which follow from idx and n alone, and these meet the nodes of the same
    coordinates. What lies higher is the same for a whole block of SPAN members, and so is asked by the block's own node, in above (gid,
    block, path, ...): no node is met by more members than a block holds, whatever the size of the group.
    """
    wide = f"element_at(array({', '.join(str(ARITY**j) for j in range(LAYER))}), j + 1)"
    first = f"idx div {wide} div {ARITY} * {ARITY}"
    there = f"transform(filter(sequence(0, {ARITY - 1}), s -> {first} + s <> idx div {wide} AND ({first} + s) * {wide} < n), s -> struct(j, {first} + s AS at))"
    levels = f"filter(sequence(0, {LAYER - 1}), j -> n > {wide})"
    asked = members.select("gid", "n", "idx", F.explode(F.expr(f"flatten(transform({levels}, j -> {there}))")).alias("c"))
    asked = asked.select("gid", "n", "idx", F.col("c.j").alias("j"), (F.col("c.j") + level).alias("level"), F.col("c.at").alias("at"))
    held = nodes.where(F.col("level").between(level, level + LAYER - 1)).select("gid", "level", F.col("idx").alias("at"), "digest")
    found = asked.join(held, ["gid", "level", "at"]).select("gid", "n", "idx", F.struct("j", "at", "digest").alias("sibling"))
    # Coordinates and members are dealt once, by block: rows of a member and its block's path then meet without another shuffle.
    both = found.unionByName(members.select("gid", "n", "idx", "info", F.lit(True).alias("own")), allowMissingColumns=True)
    both = both.withColumn("block", F.expr(f"idx div {SPAN}")).repartition("gid", "block")
    one = both.groupBy("gid", "block", "idx", "n").agg(F.array_sort(F.collect_list("sibling")).alias("siblings"), F.first("info", ignorenulls=True).alias("info"))
    side = "array_join(transform(filter(siblings, s -> s.j = j AND s.at {sign} idx div {wide}), s -> lower(hex(s.digest))), '')"
    path = f"transform({levels}, j -> struct({side.format(sign='<', wide=wide)} AS before, {side.format(sign='>', wide=wide)} AS after))"
    here = one.select("gid", "block", "idx", "n", "info", F.expr(path).cast(_PATH).alias("here"))
    return here.join(above, ["gid", "block"]).withColumn("path", F.concat("here", "path")).drop("block", "here")


def _paths(tree: Manifest, tops: DataFrame) -> DataFrame:
    """leaves (gid, n, idx, info) with path and the columns of tops (gid, size, path, ...), which go on from each group's root; size is the group's number of leaves."""
    layers = 1
    while SPAN**layers < tree.largest:
        layers += 1
    over = None
    for k in reversed(range(layers)):
        # A group's root is above the block of the layer in which it has no more than SPAN nodes.
        starts = tops.where(f"size <= {SPAN ** (k + 1)}" + (f" AND size > {SPAN**k}" if k else "")).drop("size").withColumn("block", F.lit(0).cast("long"))
        above = starts if over is None else starts.unionByName(over)
        members = tree.leaves if k == 0 else tree.nodes.where(f"level = {k * LAYER} AND n > 1").withColumn("info", F.lit(None).cast(tree.leaves.schema["info"].dataType))
        out = _climb(members.select("gid", "n", "idx", "info"), tree.nodes, above, k * LAYER)
        if k:
            over = materialise(out.withColumn("block", F.col("idx")).drop("idx", "n", "info"), "merkle-paths")
    return out


def prove(tree: Manifest) -> DataFrame:
    """A row for each leaf: the columns of info, subroot, root and path, all as hex text; path has before and after of each level up to root.

    The groups' roots, in the groups' order, are the leaves of one more tree, whose root is root; a group's way through it is asked once, not by its leaves.
    """
    total = tree.groups.count()
    tops = tree.nodes.where("n = 1").select(F.col("gid").alias("idx"), "digest")
    sized = tops.join(tree.groups.select(F.col("gid").alias("idx"), F.col("n").alias("size")), "idx")
    member = materialise(sized.select(F.lit(0).cast("long").alias("gid"), F.lit(total).cast("long").alias("n"), "idx", F.struct("size", "digest").alias("info"), "digest"), "merkle-subroots")
    upper = Manifest(member.drop("digest"), grow(member.withColumn("level", F.lit(0)).select(*_typed()), total), tree.groups, total)
    start = upper.nodes.where("n = 1").select("gid", F.lit(total).cast("long").alias("size"), F.array().cast(_PATH).alias("path"), F.lower(F.hex("digest")).alias("root"))
    ways = _paths(upper, start).select(F.col("idx").alias("gid"), "info.size", "path", F.lower(F.hex("info.digest")).alias("subroot"), "root")
    return _paths(tree, materialise(ways, "merkle-tops")).select("info.*", "subroot", "root", "path")


def fold(own: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, own, lambda got, level: F.sha2(F.concat(level["before"], got, level["after"]), 256))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path in order."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def verified(docs: DataFrame, tampered: Column | None = None, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """A row for each document: the columns of fields but text, leaf, subroot, root, path, proof_sha256, folded_root and verified.

    tampered is the text as it is found again (default: text itself): it gives another leaf, which is folded with the untampered siblings. Leaves of
    equal order are ordered by digest, so repeated rows are leaves of their own and interchangeable. Nulls are values of their own, a null
    group or order comes first; a lone document is its group's root, and a lone group's root the whole's. Empty docs: empty result. Columns other than those of fields take no part.
    """
    plain, found = ([F.col(f) if f != "text" or x is None else x for f in fields] for x in (None, tampered))
    kept = [f for f in fields if f != "text"]
    leaves = docs.select(*kept, leaf(*plain).alias("leaf"), (F.lit(None).cast("string") if tampered is None else F.nullif(leaf(*found), leaf(*plain))).alias("claimed"))
    tree = build(leaves, group, [order, "leaf"], [*kept, "leaf", "claimed"])
    proved = prove(tree).withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(F.coalesce("claimed", "leaf"), F.col("path"))})
    return proved.withColumn("verified", F.col("folded_root") == F.col("root")).drop("claimed")

"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.llm.text import fresh, words
from lathe.session import materialise

#: Weights of the sources in their order, repeated as often as needed.
WEIGHTS = (1, 2, 3)
#: No source's target exceeds its size times this, and no document is taken more often.
MAX_EPOCHS = 3
#: Hex digits of the number of slots that virtual time is cut into.
HEX_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to the same with target.

    Targets share the sum of all sizes by weight; those above cap * source_size stop there and the excess is shared again by
    weight. The fixed point is min(cap * size, level * weight), whose level follows from one running sum over the sources in
    the order in which they fill up. One row per source: the only windows without a partition key in this module are on this
    table and on the slots of virtual time.
    """
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    weighted = sizes.withColumn("weight", pick.cast("long")).withColumn("fills_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
    filling = W.Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(W.Window.unboundedPreceding, -1)
    everything = W.Window.partitionBy()
    level = weighted.select(
        "*",
        F.sum("source_size").over(everything).alias("budget"),
        F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(filling), F.lit(0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0))).alias("open_weight"),
    ).withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_weight"))
    reached = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"]
    return level.withColumn("target", F.least(F.lit(cap) * F.col("source_size").cast("double"), reached * F.col("weight"))).select(*sizes.columns, "target")


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS, seed: str = "mix", hex_digits: int = HEX_DIGITS, texts: bool = True) -> DataFrame:
    """Adds to docs (doc_id, text, source and any others): size, source_size, target, times (epochs taken) and taken.

    Each source is shuffled by md5(seed, doc_id). A document's virtual finish time in epoch e is (e * source_size + cumulative
    size) / target. All epochs of all documents, in order of finish time, are cut where their running sum of sizes would pass the
    budget, the sum of all sizes. Documents are written once with their size and place (without text, if texts is false), so that a row keeps its place, and the queue reads
    these columns alone. Cumulative sizes come in two passes: the rows of all
    sources are dealt by sampled ranges of (source, place), and running sums inside a range start at the sum of the ranges before it, so that neither a source with a third
    of all rows nor an id of as many is one task's. Virtual time is cut into slots that hold nearly equal numbers of words by construction, the slot in which the budget ends is
    cut again, and only what is left of it is ordered row by row. What an epoch takes of a source is a prefix of its shuffle order, so the cut
    comes back as one place for each source and epoch, and documents are counted where they are read, without a shuffle of texts.

    Null text and text without words: size 0, times 0, taken 0. Null source: a source of its own, last in order. Rows that
    repeat or lack a doc_id count each and have places of their own, by their text and then by their number among the rows read, so that a source whose rows
    share an id is cut near its target too. Empty input: empty result. Columns of docs named as those added are replaced; other extra columns stay, whatever their names.
    """
    added = ["size", "source_size", "target", "times", "taken"]
    rest = docs.drop(*added)
    key, place, plan = (fresh([*rest.columns, *added], n) for n in ("mix_key", "mix_place", "mix_plan"))
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    own = F.struct(mixed.alias("hash"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    sized = rest.withColumns({"size": word_count(F.col("text")), key: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("unnamed")), place: own})
    kept = [c for c in rest.columns if texts or c != "text"]
    sized = materialise(sized.select(*kept, "size", key, place), "mix-rows")
    narrow = sized.select("source", F.col(key).alias("key"), F.col(place).alias("place"), "size")
    targets = materialise(source_targets(narrow.groupBy("source", "key").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    order = ["key", "place"]
    dealt = narrow.where("size > 0").select("key", "place", "size").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "mix-ranges").withColumn("range", F.shiftright("at", 33))
    totals = materialise(dealt.groupBy("key", "range").agg(F.sum("size").alias("size")), "mix-totals")
    before = W.Window.partitionBy("key").orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = totals.select("key", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    starts = materialise(starts.join(targets.select("key", "source_size", "target"), "key"), "mix-starts")
    inside = W.Window.partitionBy("key", "range").orderBy("at")
    cumulative = dealt.withColumn("cum", F.sum("size").over(inside)).join(starts, ["key", "range"]).withColumn("cum", F.col("before") + F.col("cum"))
    queue = materialise(cumulative.drop("range", "before", "at"), "mix-queue")
    ends = materialise(_ends(queue, cap, 16**hex_digits, totals.select(F.sum("size")).scalar()), "mix-ends")
    lasts = queue.join(ends, "key").where(F.col("cum").isin(*[F.col(f"end_{e}") for e in range(cap)])).groupBy("key")
    lasts = lasts.agg(*[F.max(F.when(F.col("cum") == F.col(f"end_{e}"), F.col("place"))).alias(f"last_{e}") for e in range(cap)])
    whole = targets.join(lasts, "key", "left").select(F.col("key").alias(key), F.struct("source_size", "target", *[f"last_{e}" for e in range(cap)]).alias(plan))
    out = sized.join(materialise(whole, "mix-plan"), key, "left")
    times = sum((F.when((F.col("size") > 0) & (F.col(place) <= F.col(f"{plan}.last_{e}")), 1).otherwise(0) for e in range(1, cap)), F.when((F.col("size") > 0) & (F.col(place) <= F.col(f"{plan}.last_0")), 1).otherwise(0))
    out = out.withColumns({"source_size": F.col(f"{plan}.source_size"), "target": F.col(f"{plan}.target"), "times": times.cast("int")}).withColumn("taken", F.col("times") * F.col("size"))
    return out.select(*kept, *added)


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("cum")) / F.nullif(F.col("target"), F.lit(0.0))


def _ends(queue: DataFrame, cap: int, slots: int, budget: Column) -> DataFrame:
    """(key, end_0, end_1, ...): how far into a source's cumulative size each epoch is taken; null where nothing is.

    Items are all epochs of all documents with words, in the total order (finish, key, epoch, cum), in which only rows that are
    taken alike are equal. Slots of equal width up to time 2, by which most budgets end, then ever wider ones, grow with it; the
    slot in which the budget ends is cut into as many again.
    """
    epoch = F.explode(F.array(*map(F.lit, range(cap)))).alias("epoch")
    items = queue.select("key", "size", "cum", "source_size", "target", epoch).withColumn("finish", _finish(F.col("epoch")))
    slot = F.when(F.col("finish") < 2, F.floor(F.col("finish") * slots)).otherwise(2 * slots + F.floor(F.log2("finish") * 64))
    items = items.select("key", "size", "cum", "epoch", "finish", slot.alias("slot"))
    edge = _reached(items, "slot", budget, "mix-slot")
    inner = items.where(F.col("slot") == edge.select("slot").scalar())
    low, high = edge.select("low").scalar(), edge.select("high").scalar()
    part = F.least(F.lit(slots - 1), F.floor((F.col("finish") - low) / F.nullif(high - low, F.lit(0.0)) * slots))
    inner = inner.withColumn("part", F.coalesce(part, F.lit(0)))
    last = _reached(inner, "part", edge.select("left").scalar(), "mix-part")
    order = F.struct("finish", "key", "epoch", "cum")
    upto = F.sum("size").over(W.Window.orderBy(order))
    ordered = inner.where(F.col("part") == last.select("part").scalar()).withColumn("upto", upto).where(F.col("upto") <= last.select("left").scalar())
    ordered = materialise(ordered.select("key", "epoch", "cum"), "mix-last")
    earlier = items.where(F.col("slot") < edge.select("slot").scalar()).unionByName(inner.where(F.col("part") < last.select("part").scalar()), allowMissingColumns=True)
    taken = earlier.select("key", "epoch", "cum").unionByName(ordered).groupBy("key")
    return taken.agg(*[F.max(F.when(F.col("epoch") == e, F.col("cum"))).alias(f"end_{e}") for e in range(cap)])


def _reached(items: DataFrame, slot: str, budget: Column, name: str) -> DataFrame:
    """One row: the slot in which the running sum of sizes reaches the budget, its least and largest finish and what is left of the budget for it."""
    by_slot = items.groupBy(slot).agg(F.sum("size").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).select("*", budget.alias("budget"))
    reached = by_slot.withColumn("upto", F.sum("n").over(W.Window.orderBy(slot))).where("upto >= budget")
    return materialise(reached.agg(F.min(F.struct(slot, "low", "high", F.expr("budget - upto + n").alias("left"))).alias("e")).select("e.*"), name)

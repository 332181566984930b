"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.llm.text import fresh
from lathe.session import materialise

#: Bytes counted for a document besides those of its text.
OVERHEAD = 16
ROUNDS = 6
#: What rows are numbered by.
ORDER = ("doc_id", "size", "text_crc32")


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixer in the manner of a multiply-xorshift finaliser."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(rows: np.ndarray, total: int, seed: int = 0) -> np.ndarray:
    """The places of row numbers 0..total-1 under a keyed permutation of 0..total-1; computable for any row alone.

    A balanced Feistel network permutes the smallest square power of two that holds total; what falls outside walks on along
    its cycle until it is inside, which ends because the cycle comes back to the start, and takes under four steps on average.
    """
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = np.asarray(rows).astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, seed * ROUNDS + r + 1) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo[todo] = out[todo] >= np.uint64(total)
    return out.astype(np.int64)


def row_numbers(df: DataFrame, by: list[str], column: str = "row") -> DataFrame:
    """df with gapless global row numbers from 0 in the order of `by`, in two passes.

    Rows are range-partitioned, sorted and written with their partition and place; the partitions' totals give offsets. Rows equal
    in `by` may be dealt to several partitions, so that no value is too frequent; which of them comes first isn't defined.
    The only rows gathered in one task are one per partition, and they are read back as a table whose size is known.
    """
    tie, at, part, start = (fresh(df.columns + by, n) for n in ("tie", "at", "part", "start"))
    spread = df.withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    placed = spread.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], F.col(tie)).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by], tie)
    placed = materialise(placed.drop(tie).withColumn(at, F.monotonically_increasing_id()), "rows")
    split = F.shiftright(F.col(at), 33).alias(part)
    sizes = placed.groupBy(split).agg(F.count("*").alias("n"))
    before = W.Window.orderBy(part).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = materialise(sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start)), "row-starts")
    return placed.withColumn(part, F.shiftright(F.col(at), 33)).join(starts, part).withColumn(column, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, start)


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, order: tuple[str, ...] = ORDER) -> DataFrame:
    """docs (doc_id, text) with size, text_crc32, law, shard, slot and grown_shard; numbers of rows differ by one at most.

    Rows are numbered by doc_id (then size and checksum, so that a rerun over other files or partitions agrees), the number is
    permuted, and the place gives shard = place mod shards and slot = place div shards: gapless, and computable from the number
    alone. law is "rows"; grown_shard, which only the law "key" has, is null. Null text: size OVERHEAD, checksum 0. Null doc_ids come first. Repeated
    rows are rows like others. Empty input: empty result. Columns of docs named as those added are replaced.
    """
    return place(measured(docs.drop("law", "shard", "slot", "grown_shard")), shards, seed, order)


def measured(docs: DataFrame) -> DataFrame:
    """docs with size and text_crc32; drop text after it where only the places are wanted, and it is never shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("size", F.octet_length(text).cast("long") + OVERHEAD).withColumn("text_crc32", F.crc32(text.cast("binary")))


def place(sized: DataFrame, shards: int = 40, seed: int = 0, order: tuple[str, ...] = ORDER) -> DataFrame:
    """sized (with the columns of order) with law, shard, slot and grown_shard."""
    row = fresh(sized.columns, "global_row")
    numbered = row_numbers(sized, list(order), row)
    total = numbered.count()

    @F.pandas_udf("long")
    def placed(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), total, seed))

    where = fresh(numbered.columns, "place")
    out = numbered.withColumn(where, placed(F.col(row)))
    return out.select(
        *sized.columns, F.lit("rows").alias("law"), F.pmod(F.col(where), F.lit(shards)).cast("int").alias("shard"), F.expr(f"`{where}` div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

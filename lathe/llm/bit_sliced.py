"""Exact top-k by inner product over a bit-sliced index of quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.session import materialise

#: Steps of the quantisation per unit.
STEPS = 1024
#: Rows of one block of the index and queries that meet it in one task.
BLOCK, QUERIES = 16_384, 16_384


def quantised(vector: Column, steps: int = STEPS) -> Column:
    """floor(steps * x) of every component; null for null vectors and for those with a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * steps)))


def slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps of non-negative integers (rows x attributes): (attributes, bits, bytes) and the number of rows."""
    bits = max(1, int(values.max()).bit_length()) if values.size else 1
    out = np.stack([np.packbits((values.T >> b) & 1, axis=1, bitorder="little") for b in range(bits)], axis=1)
    words = -(-out.shape[2] // 8) * 8
    return np.ascontiguousarray(np.pad(out, ((0, 0), (0, 0), (0, words - out.shape[2])))).view(np.uint64), len(values)


def digits(weights: np.ndarray) -> list[list[tuple[int, bool]]]:
    """By power of two: (attribute, negative) for the nonzero digits of the weights, signed so that few are nonzero."""
    places: list[list[tuple[int, bool]]] = []
    for j, w in enumerate(map(int, weights)):
        place = 0
        while w:
            if w & 1:
                step = 2 - (w & 3)
                while len(places) <= place:
                    places.append([])
                places[place].append((j, step < 0))
                w -= step
            w >>= 1
            place += 1
    return places


def _add(total: np.ndarray, carry: np.ndarray, addend: np.ndarray) -> None:
    """Carry-save addition in place: total + carry stays the sum, all slices at once."""
    n = len(addend)
    half = total ^ carry
    out = total & carry
    out[:n] |= half[:n] & addend
    half[:n] ^= addend
    total[:] = half
    carry[0] = 0
    carry[1:] = out[:-1]


def _ripple(total: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """total + carry as plain slices."""
    over = np.zeros_like(total[0])
    for i in range(len(total)):
        a, b = total[i], carry[i]
        half = a ^ b
        total[i], over = half ^ over, (a & b) | (half & over)
    return total


def scores_sliced(index: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of sum(weights * values) + shift, and the shift that keeps all sums non-negative.

    A weight is a sum of signed powers of two. Each adds an attribute's slices, or their complements where negative, to the
    sum of its power; from the highest power down sums are doubled and added up.
    """
    bits = index.shape[1]
    top = (1 << bits) - 1
    places = digits(weights)
    width = bits + 1 + sum(max(1, len(p)) for p in places).bit_length() + len(places)
    total, carry = (np.zeros((width, index.shape[2]), np.uint64) for _ in range(2))
    shift = 0
    for place in range(len(places) - 1, -1, -1):
        total[1:], carry[1:] = total[:-1].copy(), carry[:-1].copy()
        total[0], carry[0] = 0, 0
        for j, negative in places[place]:
            _add(total, carry, ~index[j] if negative else index[j])
            shift += (top << place) if negative else 0
    return _ripple(total, carry), shift


def top_rows(sums: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k largest sums and of those that tie at the boundary, from the top slice down."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    for s in sums[::-1]:
        found = sure | (tied & s)
        n = int(np.bitwise_count(found).sum())
        if n > k:
            tied &= s
        else:
            sure, tied = found, tied & ~s
            if n == k:
                return sure, np.zeros_like(tied)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best rows of a block, boundary ties to smaller ids, own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = int(values.min())
    index, n = slices(values - low)
    everyone = np.pad(np.packbits(np.ones(n, np.uint8), bitorder="little"), (0, index.shape[2] * 8 - -(-n // 8))).view(np.uint64)
    out = []
    for query_id, query in zip(query_ids, queries, strict=True):
        allowed = everyone
        if len(own := np.arange(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, "right"))):
            mask = np.unpackbits(everyone.view(np.uint8), bitorder="little")
            mask[own] = 0
            allowed = np.packbits(mask, bitorder="little").view(np.uint64)
        sums, _ = scores_sliced(index, query)
        sure, tied = top_rows(sums, allowed, k)
        best = _rows(sure)
        best = np.concatenate([best, _rows(tied)[: max(0, k - len(best))]])
        out += [(int(query_id), int(ids[r]), int(values[r] @ query)) for r in best]
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 10, steps: int = STEPS, block: int = BLOCK, many: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) that `queries` names, its k best others.

    Candidates are dealt into blocks by a hash of vec_id and queries into batches; every batch meets every block, one task
    each, where the block's bit slices are added, and the k best of each block meet again per query. Bounded by block and
    many, no task holds more. Scores are integers, so results don't hang on the blocks.

    Null vectors, empty ones and those with null or non-finite components take no part; nor do null ids. Candidates with the
    query's own id are left out, so rows that repeat it are too. Repeated ids elsewhere are rows of their own. Vectors of
    another length than a query's are candidates of no query of that length. Fewer than k candidates: all. Extra columns are left out.
    """
    rows = materialise(vectors.select("vec_id", quantised(F.col("embedding"), steps).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("dims", F.size("v")), "sliced-rows")
    asked = rows.where(queries)
    n, m = rows.count(), asked.count()
    blocks, batches = max(1, -(-n // block)), max(1, -(-m // many))
    spread = lambda df, seed, parts: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    left = rows.withColumn("block", spread(rows, 1, blocks)).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    right = asked.withColumn("batch", spread(asked, 2, batches)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("v").combine_chunks()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        return table.column("vec_id").to_numpy(), flat.flatten().to_numpy().reshape(table.num_rows, -1)

    def meet(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        found = search_block(*arrays(candidates), *arrays(wanted), k) if candidates.num_rows and wanted.num_rows else []
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, schema=schema)

    keys = ["dims", "batch", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

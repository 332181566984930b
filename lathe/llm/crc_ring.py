"""Importance resampling towards a target's distribution of hashed word n-grams, hashed by a ring of running CRC states."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.feistel import row_numbers
from lathe.llm.text import fresh
from lathe.session import materialise

#: Longest run of words that is a feature, number of buckets, and how many buckets come to the driver and to tasks at most (8 bytes each).
GRAMS, BUCKETS, MOST_BUCKETS = 1, 10_000, 1 << 20
#: Fewest words of a document that may be drawn, per cent of those that are, and the seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of a text whose words are split at once, and states that are counted at once.
STRETCH, TOGETHER = 1 << 20, 1 << 17

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in order, in lists of STRETCH bytes or of one longer word."""
    raw, start = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS), 0
    while len(raw) - start > STRETCH:
        cut = raw.rfind(b" ", start + 1, start + STRETCH)
        cut = cut if cut > start else raw.find(b" ", start + STRETCH)
        if cut < 0:
            break
        yield raw[start:cut].split()
        start = cut
    yield raw[start:].split()


def states(text: str | None, grams: int = GRAMS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRC-32 of every run of 1 to `grams` consecutive words joined by a space) of each stretch of a text, in one scan.

    The ring holds the running state of the last grams - 1 starts. A word extends each of them by a space and itself, and starts a
    state of its own; all are emitted. The ring goes on from one stretch to the next, so that no run is lost or counted twice.
    """
    ring: list[int] = []
    for words in _word_lists(text):
        if grams == 1:
            yield len(words), np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
            continue
        out = []
        for word in words:
            spaced = b" " + word
            ring = [*[zlib.crc32(spaced, state) for state in ring], zlib.crc32(word)]
            out += ring
            if len(ring) == grams:
                ring.pop(0)
        yield len(words), np.array(out, np.uint32)


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts (column text) fall into each bucket; buckets without any are left out.

    Each task counts into an array of its own and gives a row a bucket, so what is shuffled doesn't grow with the length of texts.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, held, size = np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                for _, found in states(text.as_py(), grams):
                    held.append(found)
                    size += len(found)
                    if size >= TOGETHER:
                        totals += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
                        held, size = [], 0
        if held:
            totals += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(totals[some], pa.int64())], names=["bucket", "n"])

    return texts.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln) of the ratio of its smoothed share among the target's features and its share among raw's, over all texts of both."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"the gains of 1 to {MOST_BUCKETS} buckets are held in memory, not of {buckets}")
    both = bucket_counts(raw, grams, buckets).select("bucket", F.lit(0).alias("side"), "n").unionByName(bucket_counts(target, grams, buckets).select("bucket", F.lit(1).alias("side"), "n"))
    counts = np.zeros((2, buckets), np.int64)
    for row in materialise(both, "crc-buckets").collect():
        counts[row.side, row.bucket] = row.n
    all_raw, all_target = (float(x) + buckets for x in counts.sum(axis=1))
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_raw / (float(s + 1) * all_target))) for s, t in counts.T.tolist()], np.int64)


def weigh(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) with n_words, n_features, weight (sum of its features' gains) and score (weight and Gumbel noise of its id).

    target has text, one row a document, and both are counted whole. Null, empty and wordless texts have no features and weight 0. A null
    doc_id has the noise of the id "null"; repeated rows count each and score alike. An empty target is a uniform one; empty docs: empty
    result. Columns named like those added are replaced, other extra columns stay.
    """
    gain = gains(docs, target, grams, buckets)

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros((3, len(texts)), np.int64)
            for i, text in enumerate(texts):
                for words, found in states(text.as_py(), grams):
                    out[:, i] += words, len(found), gain[found % buckets].sum()
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n_words", "n_features", "weight"])

    added = ["n_words", "n_features", "weight", "score"]
    rest = docs.drop(*added)
    held = fresh([*rest.columns, *added], "weighed")
    found = rest.withColumn(held, F.arrow_udf(over, "n_words long, n_features long, weight long")(F.col("text")))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    return found.select(*rest.columns, *[F.col(f"{held}.{c}") for c in added[:3]], (F.col(f"{held}.weight") + noise).alias("score"))


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """weighed (doc_id, n_words, n_features, weight, score and any others) with rank: 1, 2, ... of those drawn, null for the rest.

    Of the documents with least_words words, `percent` per cent (rounded down) are drawn: those of the highest scores, ties to the smaller
    doc_id, a null one last. Rows are numbered globally in two passes, so no task and no driver sees more than its range. All
    columns given are shuffled: leave texts out.
    """
    out, late, low, row = weighed.drop("rank"), *(fresh([*weighed.columns, "rank"], n) for n in ("late", "low", "row"))
    ordered = out.withColumns({late: F.when(F.col("n_words") >= least_words, F.col("doc_id").isNull().cast("int")).otherwise(2), low: -F.col("score")})
    short = fresh([*ordered.columns, "rank"], "short")
    numbered = row_numbers(ordered.withColumn(short, (F.col(late) == 2).cast("int")), [short, low, late, "doc_id", "n_features", "weight"], row)
    most = numbered.where(F.col(short) == 0).select(F.expr(f"count(*) * {percent} div 100")).scalar()
    return numbered.withColumn("rank", F.when((F.col(short) == 0) & (F.col(row) < most), F.col(row) + 1)).select(*out.columns, "rank")

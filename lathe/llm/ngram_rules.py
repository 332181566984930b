"""Quality rules: counts per document and a hashed n-gram log-likelihood ratio, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.llm.text import has_word, words
from lathe.session import materialise

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Fewest words, words of a repeat window, largest share of repeated words (percent).
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
#: Buckets of the hashed unigrams and bigrams, and the share of the uniform distribution in both multinomials.
BUCKETS, UNIFORM = 1 << 16, 0.2
#: The threshold leaves out this share of the trusted documents, each scored by a target that was counted without its fold.
REJECTED, FOLDS = 0.002, 5
#: Ratios are whole multiples of 1 / _UNIT, so that no order of additions matters, and the threshold of 1 / _GRID.
_UNIT, _GRID = 10_000, 1_000


def _neighbours(array: str, step: int) -> Column:
    """Hashes of the elements at i and i + step, for all i that have both."""
    n = f"greatest(size({array}) - {step}, 0)"
    return F.expr(f"zip_with(slice({array}, 1, {n}), slice({array}, {1 + step}, {n}), (a, b) -> xxhash64(a, b))")


def _repeats(docs: DataFrame) -> DataFrame:
    """From _h2 (hashes of word pairs) the column n_repeat_words: words in windows of eight that occur twice or more.

    Pairs of pairs of pairs give the windows' hashes. Only documents with an equal pair of windows are sorted; the sorted
    windows' equal neighbours give the places, and gaps between places the words covered.
    """
    windows = docs.withColumn("_h4", _neighbours("_h2", 2)).withColumn("_h8", _neighbours("_h4", 4)).drop("_h4")
    doubled = F.size(F.array_distinct("_h8")) < F.size("_h8")
    ordered = windows.withColumn("_sorted", F.when(doubled, F.expr("sort_array(transform(_h8, (x, i) -> struct(x AS h, i AS i)))"))).drop("_h8")
    same = "zip_with(slice(_sorted, 1, size(_sorted) - 1), slice(_sorted, 2, size(_sorted) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), array()))"
    at = ordered.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.expr(f"sort_array(array_distinct(flatten({same})))"))).drop("_sorted")
    covered = f"aggregate(zip_with(slice(_at, 1, size(_at) - 1), slice(_at, 2, size(_at) - 1), (a, b) -> least({REPEAT_WINDOW}, b - a)), {REPEAT_WINDOW}, (s, x) -> s + x)"
    return at.withColumn("n_repeat_words", F.when(F.col("_at").isNotNull(), F.expr(covered)).otherwise(0).cast("long")).drop("_at")


def _hashed(docs: DataFrame, of: Column) -> DataFrame:
    """Adds _h1 and _h2: hashes of the words, given as an array, and of the pairs of neighbouring words."""
    return docs.withColumn("_h1", F.transform(of, lambda w: F.xxhash64(w))).withColumn("_h2", _neighbours("_h1", 1))


def trusted(labels: DataFrame) -> DataFrame:
    """The doc_ids (distinct) of the trusted target: all rows of quality 1."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted_id")).distinct()


def trusted_docs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Text and fold of all trusted docs, written, so that texts meet the ids by one shuffle and not by one for each use.

    The ids grow with the input, so they are never broadcast: the plan is the same at every size.
    """
    known = docs.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("trusted_id"))
    return materialise(known.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "ngram-known")


def ratios(docs: DataFrame, known: DataFrame, buckets: int = BUCKETS, uniform: float = UNIFORM) -> DataFrame:
    """One row for each of the buckets: ratio, ln of target by corpus probability in units of 1 / _UNIT, and without, the same for targets less a fold.

    Two multinomials over the hashed unigrams and bigrams: the corpus' counts those of all docs, the target's those of all
    trusted docs (known); both are mixed with `uniform` of the uniform distribution. Only shares count, so a table that holds
    every row twice gives the same ratios. A target without n-grams gives ratios of zero; a bucket without any has one that no document reads.
    """

    def grams(df: DataFrame, *also: str) -> DataFrame:
        hashed = _hashed(df.select("text", *also), words(F.col("text"))).select(F.explode(F.concat("_h1", "_h2")).alias("h"), *also)
        return hashed.select(F.pmod("h", F.lit(buckets)).alias("bucket"), *also)

    raw = grams(docs).groupBy("bucket").agg(F.count("*").alias("raw"))
    names = [f"fold_{k}" for k in range(FOLDS)]
    folds = grams(known, "fold").groupBy("bucket").agg(*[F.count_if(F.col("fold") == k).alias(n) for k, n in enumerate(names)])
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(raw, "bucket", "left").join(folds, "bucket", "left")
    counted = materialise(every.select("bucket", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("raw", *names)]), "ngram-counts")
    # One row of totals; as scalar subqueries each use would be planned and run on its own.
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns[1:]]).first()
    total = {c: F.lit(sums[c]).cast("long") for c in counted.columns[1:]}
    good, good_sum = (sum((x[n] for n in names[1:]), x[names[0]]) for x in (counted, total))

    def ratio(count: Column, of: Column) -> Column:
        target, corpus = ((1 - uniform) * n / m + uniform / buckets for n, m in ((count, of), (counted["raw"], total["raw"])))
        return F.when(of > 0, F.round(F.ln(target / corpus) * _UNIT)).otherwise(0).cast("int")

    without = F.array(*[ratio(good - counted[n], good_sum - total[n]) for n in names])
    return materialise(counted.select("bucket", ratio(good, good_sum).alias("ratio"), without.alias("without")), "ngram-ratios")


def tables(ratios: DataFrame) -> DataFrame:
    """One row: ratio, the ratios in order of their buckets, and without, each bucket's by fold after the other's; for the scalar subqueries of _with_mean().

    They have `buckets` numbers, or that for each fold, whatever the size of the input, and go from the table to the tasks
    without being part of a plan or passing the driver's Python.
    """
    ordered = ratios.agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio", "without"))).alias("rows"))
    return materialise(ordered.select(F.col("rows.ratio").alias("ratio"), F.flatten("rows.without").alias("without")), "ngram-tables")


def _with_mean(docs: DataFrame, name: str, table: Column, buckets: int, step: int = 1, start: Column | int = 0) -> DataFrame:
    """docs with the column `name`: mean ratio of the n-grams of _h1 and _h2, null without any. It is summed inside the row, so that no n-gram is ever a row.

    A bucket's ratio is at start + step * bucket of the table.
    """
    grams = F.concat("_h1", "_h2")
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda s, h: s + F.get("_table", (start + step * F.pmod(h, F.lit(buckets))).cast("int")))
    # The planner then puts the subquery into the sum; nullif() would make it a column, copied for each row.
    return docs.withColumn("_table", table).withColumn(name, F.when(F.size(grams) > 0, total / F.size(grams) / _UNIT)).drop("_table")


def _counted(docs: DataFrame) -> DataFrame:
    """docs (text and others) with the counts, base_failed, _h1 and _h2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = sum((F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS[1:]), F.octet_length(F.replace(text, F.lit(SYMBOLS[0]), F.lit(""))))
    counted = docs.withColumns({"n_symbols": (len(SYMBOLS) * F.octet_length(text) - symbols).cast("long"), "_lines": F.filter(F.split(text, "\n"), has_word), "_words": words(F.col("text"))})
    counted = counted.withColumns({"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "word_chars": F.char_length(F.array_join("_words", "")).cast("long")})
    counted = _repeats(_hashed(counted.drop("_lines"), F.col("_words")).drop("_words").withColumn("n_words", F.size("_h1").cast("long")))
    return counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def threshold(known: DataFrame, without: Column, buckets: int = BUCKETS, rejected: float = REJECTED) -> Column:
    """The largest ratio on the grid that at most `rejected` of the trusted docs (known) are below, of those that pass the base rules; null without any.

    Each is scored by the target less its own fold, which says how a document fares that the target doesn't hold. Scores are counted
    on the grid, so the quantile is exact and the one task that orders them sees the grid alone.
    """
    means = _with_mean(_counted(known), "mean", without, buckets, FOLDS, F.col("fold"))
    scored = means.select("base_failed", F.floor(F.col("mean") * _GRID).alias("score"), F.monotonically_increasing_id().alias("row"))
    grid = scored.where("NOT base_failed AND row >= 0").groupBy("score").agg(F.count("*").alias("n"))
    below = F.sum("n").over(W.Window.orderBy("score")) - F.col("n")
    ranked = grid.select("score", below.alias("below"), F.sum("n").over(W.Window.partitionBy()).alias("all"))
    return materialise(ranked.where(F.col("below") <= rejected * F.col("all")).agg((F.max("score") / _GRID).alias("least")), "ngram-threshold").scalar()


def _judged(docs: DataFrame, labels: DataFrame, rejected: float, buckets: int, uniform: float) -> DataFrame:
    """docs (text and others whose names don't clash) with all of judge()'s columns."""
    ids = materialise(trusted(labels), "ngram-trusted")
    known = trusted_docs(docs.select(F.col("_doc.doc_id").alias("doc_id"), "text"), ids)
    model = tables(ratios(docs, known, buckets, uniform))
    least = threshold(known, model.select("without").scalar(), buckets, rejected)
    scored = _with_mean(_counted(docs), "ratio", model.select("ratio").scalar(), buckets).drop("_h1", "_h2")
    # The row's number keeps filters on the verdicts above what they are computed from, which they would otherwise unfold.
    barred = scored.withColumn("_row", F.monotonically_increasing_id())
    alike = F.coalesce(F.col("ratio") >= F.coalesce(least, F.lit(float("-inf"))), F.lit(False))
    return barred.withColumns({"kept": ~F.col("base_failed") & alike & (F.col("_row") >= 0), "base_failed": F.col("base_failed") & (F.col("_row") >= 0)}).drop("_row")


def judge(docs: DataFrame, labels: DataFrame, rejected: float = REJECTED, buckets: int = BUCKETS, uniform: float = UNIFORM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, the counts, base_failed, ratio (mean, null without words), kept.

    A document fails the base rules with under LEAST_WORDS words or over MOST_REPEATED % of words in repeated windows. The
    others are kept if their mean log-likelihood ratio over all unigrams and bigrams reaches the threshold that leaves out
    `rejected` of the trusted documents. Counts and threshold come from all rows; the tables of ratios have `buckets` numbers a
    fold and go to the tasks as scalar subqueries. A document is judged in the task that reads it, without a shuffle.

    Null and empty texts have zero counts and fail. Null doc_ids and repeated rows are documents like others. Labels that
    are null or name no document count as absent; without trusted documents the base rules decide alone. Empty docs: empty
    result. Extra columns are left out.
    """
    judged = _judged(docs.select(F.struct("doc_id").alias("_doc"), "text"), labels, rejected, buckets, uniform)
    return judged.select("_doc.doc_id", F.xxhash64("text").alias("text_hash"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


def keep(docs: DataFrame, labels: DataFrame, rejected: float = REJECTED) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; what judge() says of nulls, repeats and empty tables holds here."""
    return _judged(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), labels, rejected, BUCKETS, UNIFORM).where("kept").select("_doc.*")

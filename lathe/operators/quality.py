"""Data-quality checks: each gives the rows, or counted labels, that break a rule; no rows means passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows) of the columns that hold nulls, in one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in columns])).alias("r")).select("r.*").where("rows > 0")


def not_accepted(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """(value, rows) of values outside the list; null passes."""
    return df.where(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def out_of_range(df: DataFrame, rules: Mapping[str, tuple[float, float, str]]) -> DataFrame:
    """(column, severity, rows) for {column: (low, high, severity)}, in one scan; null passes."""
    counts = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi, _) in rules.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(rule[2]).alias("severity"), F.col(c).alias("rows")) for c, rule in rules.items()])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("rows > 0")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(key, rows) of keys without a parent; null keys pass."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    return keys.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def not_constant(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column) where a column has more than one value in a key; null counts as no value."""
    wide = df.groupBy(*keys).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    bad = F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns])))
    return wide.select(*keys, bad.alias("column"))


def labelled(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Every row and rule that it breaks; a rule that is null counts as broken, so that checks fail closed."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(bad).alias("violation"))


def counts_of(violations: DataFrame) -> DataFrame:
    return violations.groupBy("violation").agg(F.count("*").alias("rows"))


def differing(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(column, rows, largest) of columns that differ between two relations; null equals null and NaN equals NaN."""
    other = right.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *columns)])
    both = left.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full")
    rows = []
    for c in columns:
        gap = F.abs(F.col(c) - F.col(f"_{c}")) if dict(left.dtypes)[c] in ("double", "float", "bigint", "int") else F.lit(None).cast("double")
        same = F.col(c).eqNullSafe(F.col(f"_{c}")) | F.coalesce(gap <= tolerance, F.lit(False))
        rows.append(F.struct(F.lit(c).alias("column"), F.count_if(~same).alias("rows"), F.coalesce(F.max(gap).cast("double"), F.lit(0.0)).alias("largest")))
    return both.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("rows > 0")


def check_columns(df: DataFrame, required: Sequence[str], forbidden: Sequence[str] = (), exact: bool = True) -> None:
    """Raises if columns are missing, forbidden or, with exact, extra or in another order; looks at the plan, not at rows."""
    have, want = list(df.columns), list(required)
    problems = [f"missing {c}" for c in want if c not in have] + [f"forbidden {c}" for c in forbidden if c in have]
    if exact:
        problems += [f"unexpected {c}" for c in have if c not in want]
        if not problems and have != want:
            problems.append("order differs")
    if problems:
        raise ValueError("; ".join(problems))


def check_knowable(schema: StructType, allowed: Sequence[str]) -> None:
    """Raises if a field's metadata says that it is known later than allowed, or says nothing."""
    late = [f.name for f in schema if f.metadata.get("knowable_at") not in allowed]
    if late:
        raise ValueError(f"not knowable in time: {', '.join(late)}")


def incomplete_months(found: DataFrame, first: str, last: str, keys: Sequence[str] = ()) -> DataFrame:
    """Months from first to last that `found` (column month, a date) lacks."""
    span = found.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return span.join(found.select("month").distinct(), "month", "left_anti")


def block_rules(position: str, total: str, inbound: Sequence[str], bounds: Mapping[str, tuple[float, float]], whole: Sequence[str]) -> dict[str, Column]:
    """Rules for labelled(): a request's rotation block is given whole and in range, or not at all.

    total is needed with a position and never below it; the inbound columns come together, and from the second position on they must.
    """
    given = sum((F.col(c).isNotNull().cast("int") for c in inbound[1:]), F.col(inbound[0]).isNotNull().cast("int"))
    placed, counted = F.col(position).isNotNull(), F.col(total).isNotNull()
    rules = {f"{c}_range": F.col(c).isNull() | F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()}
    rules |= {f"{c}_whole": F.col(c).isNull() | (F.col(c) % 1 == 0) for c in whole}
    return rules | {
        "no_position": placed | (~counted & (given == 0)),
        "no_total": ~placed | counted,
        "total_below_position": ~placed | ~counted | (F.col(total) >= F.col(position)),
        "inbound_in_part": given.isin(0, len(inbound)),
        "inbound_needed": ~placed | (F.col(position) < 2) | (given == len(inbound)),
    }


def observation_violations(df: DataFrame, keys: Sequence[str], departure: str, observed: str, flag: str, within: int, most_missing: float) -> DataFrame:
    """(keys, violation) of matched observations: known at departure, at most `within` seconds old, flag as found; null keys for the share without any.

    A match whose departure is unknown can't be verified and is a violation, not a pass.
    """
    at, seen = F.unix_micros(F.col(departure).cast("timestamp")), F.unix_micros(F.col(observed).cast("timestamp"))
    either = seen.isNull() | at.isNull()
    rules = {
        "observed_after_departure": either | (seen <= at),
        "outside_lookback": either | (seen > at - within * 1_000_000),
        "flag_without_observation": ~F.col(flag) | seen.isNotNull(),
        "observation_without_flag": F.col(flag) | seen.isNull(),
        "cannot_verify": seen.isNull() | at.isNotNull(),
    }
    share = df.agg((F.count_if(~F.col(flag)) / F.nullif(F.count("*"), F.lit(0))).alias("missing")).where(F.col("missing") > most_missing)
    types = {f.name: f.dataType for f in df.schema}
    return labelled(df, rules, keys).unionByName(share.select(*[F.lit(None).cast(types[k]).alias(k) for k in keys], F.lit("too_many_missing").alias("violation")))


def nested_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, path, left, right): every place at which rows of the same keys differ, in columns of any depth.

    Both have the same columns. The walk follows the schema: fields by name, entries of a map by key (a missing one is null), elements by number from 0; arrays of other lengths
    are one difference, of their lengths. Null equals null and NaN equals NaN; a null in place of a struct, array or map is one difference. A row that only one side has differs at
    path "". Values are given as text, whole structures as JSON. Keys are unique on either side; the sides meet by one shuffle and only differences become rows.
    """
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (left, right)]
    if types[0] != types[1]:
        raise ValueError(f"columns or types differ: {sorted(set(types[0]) ^ set(types[1]))}")
    rest = [c for c in left.columns if c not in keys]
    sides = [df.select(*[F.col(k).alias(f"_{n}{k}") for k in keys], F.struct(*rest, F.lit(True).alias("_there")).alias(n)) for n, df in (("l", left), ("r", right))]
    both = sides[0].join(sides[1], [F.col(f"_l{k}").eqNullSafe(F.col(f"_r{k}")) for k in keys], "full")
    found = [_walk(F.col("l")[c], F.col("r")[c], types[0][c], F.lit(c)) for c in rest]
    alone = _difference(F.lit(""), F.when(F.col("l").isNotNull(), "row"), F.when(F.col("r").isNotNull(), "row"))
    listed = F.when(F.col("l").isNull() | F.col("r").isNull(), alone).otherwise(F.concat(*found) if found else _nothing())
    return both.select(*[F.coalesce(F.col(f"_l{k}"), F.col(f"_r{k}")).alias(k) for k in keys], F.explode(listed).alias("d")).select(*keys, "d.*")


def _nothing() -> Column:
    return F.array().cast("array<struct<path: string, left: string, right: string>>")


def _difference(path: Column, one: Column, two: Column) -> Column:
    return F.array(F.struct(path.alias("path"), one.alias("left"), two.alias("right")))


def _walk(one: Column, two: Column, kind: DataType, path: Column) -> Column:
    """The array of differences between two values of a type."""
    if isinstance(kind, (StructType, ArrayType, MapType)):
        shown = lambda v: F.when(v.isNotNull(), F.to_json(v))
        if isinstance(kind, StructType):
            parts = [_walk(one[f.name], two[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
            inner = F.concat(*parts) if parts else _nothing()
        elif isinstance(kind, ArrayType):
            places = F.filter(F.sequence(F.lit(0), F.size(one)), lambda i: i < F.size(one))
            each = F.flatten(F.transform(places, lambda i: _walk(F.get(one, i), F.get(two, i), kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            lengths = _difference(F.concat(path, F.lit(".length")), F.size(one).cast("string"), F.size(two).cast("string"))
            inner = F.when(F.size(one) != F.size(two), lengths).otherwise(each)
        else:
            names = F.array_sort(F.array_union(F.map_keys(one), F.map_keys(two)))
            inner = F.flatten(F.transform(names, lambda k: _walk(F.element_at(one, k), F.element_at(two, k), kind.valueType, F.concat(path, F.lit("."), k.cast("string")))))
        same_kind = F.when(one.isNotNull() & two.isNotNull(), inner).otherwise(_difference(path, shown(one), shown(two)))
        return F.when(one.isNull() & two.isNull(), _nothing()).otherwise(same_kind)
    return F.when(one.eqNullSafe(two), _nothing()).otherwise(_difference(path, one.cast("string"), two.cast("string")))


def not_single(parents: DataFrame, key: str, rows: DataFrame, of: str) -> DataFrame:
    """(key, rows) of the parents' keys that have no row, or more than one, in `of` of rows; null keys take no part."""
    held = rows.groupBy(F.col(of).alias("_of")).agg(F.count("*").alias("rows"))
    keys = parents.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.join(held, F.col(key) == F.col("_of"), "left").select(key, F.coalesce("rows", F.lit(0)).alias("rows")).where("rows <> 1")


def months_of(df: DataFrame, day: str) -> DataFrame:
    """(month, rows) of every month from the first to the last of a table, as its first day; months without a row have 0."""
    month = F.trunc(F.col(day).cast("date"), "MM")
    held = df.where(F.col(day).isNotNull()).groupBy(month.alias("month")).agg(F.count("*").alias("rows"))
    span = held.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo IS NOT NULL")
    every = span.select(F.explode(F.expr("sequence(lo, hi, INTERVAL 1 MONTH)")).alias("month"))
    return every.join(held, "month", "left").select("month", F.coalesce("rows", F.lit(0)).alias("rows"))

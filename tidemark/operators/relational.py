"""Point-in-time relational operators."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_of_filter(df: DataFrame, as_of: datetime | str, column: str = "available_at") -> DataFrame:
    """Rows that were knowable at as_of; a naive datetime and a frame without the column are refused."""
    if column not in df.columns:
        raise ValueError(f"no column {column}: availability is needed for a point-in-time read")
    if isinstance(as_of, datetime):
        if as_of.tzinfo is None:
            raise ValueError("as_of needs a time zone")
        as_of = as_of.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return df.where(F.col(column) <= F.lit(as_of).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, value: str, name: str, by: list[str] | None = None, on: str = "available_at") -> DataFrame:
    """left with the value of the latest right row whose `on` is at or before the left row's; a null value still counts.

    Both sides are stacked and one running window picks the latest, so the work is a sort for each `by` key and grows
    in proportion to the rows. Without `by` the windows are months: a month starts with the last value of the months
    before it, which one row a month carries over.
    """
    kinds = dict(left.dtypes)
    seen = right.where(F.col(on).isNotNull()).withColumn("__value", F.struct(F.col(value).alias("v")))
    keys = by
    if by is None:
        keys = ["__month"]
        left = left.withColumn("__month", F.trunc(on, "month"))
        seen = seen.select(on, "__value", F.trunc(on, "month").alias("__month"), F.lit(0).alias("__side"))
        last = seen.groupBy("__month").agg(F.max_by("__value", on).alias("__value"))
        months = left.select("__month").distinct().join(last, "__month", "full")
        before = F.last("__value", ignorenulls=True).over(W.orderBy("__month").rowsBetween(W.unboundedPreceding, -1))
        carried = months.select("__month", before.alias("__value")).where("__value is not null")
        # it comes before what is known at the month's first instant
        seen = seen.unionByName(carried.select(F.col("__month").cast(kinds[on]).alias(on), "__value", "__month", F.lit(-1).alias("__side")))
    else:
        seen = seen.withColumn("__side", F.lit(0))
    pad = [c for c in left.columns if c not in (*keys, on)]
    tagged = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(seen.schema["__value"].dataType).alias("__value"))
    other = seen.select(*keys, on, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in pad), "__side", "__value")
    w = W.partitionBy(*keys).orderBy(on, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = tagged.unionByName(other).withColumn("__value", F.last("__value", ignorenulls=True).over(w))
    return both.where("__side = 1").withColumn(name, F.col("__value.v")).drop("__side", "__value", "__month")


def lookup(asked: DataFrame, book: DataFrame, value: str, keys: list[str], as_of: str = "as_of", available: str = "available_at") -> DataFrame:
    """asked with the book's value under the same keys, if it was knowable at the row's as_of; null otherwise.

    Of entries that share their keys, the last one that was knowable counts (of equal instants the largest value), so no
    asked row comes twice. asked keeps its own columns; a column named like the value is replaced.
    """
    entry = F.struct(F.col(available).alias("known"), F.col(value).alias("v"))
    entries = book.where(F.col(available).isNotNull()).groupBy(*keys).agg(F.collect_set(entry).alias("__entries"))
    met = asked.drop(value).join(entries, keys, "left")
    known = F.array_max(F.filter("__entries", lambda e: e["known"] <= F.col(as_of)))
    return met.withColumn(value, known["v"]).drop("__entries")


def interval_join(dates: DataFrame, members: DataFrame, at: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """dates joined with the memberships that hold at each: valid_from <= at < valid_to, an open end being null.

    Without keys the two sides meet by month, a membership once for each month that it shares with the span of dates, so
    no date is compared with memberships of other times.
    """
    inside = (F.col("m.valid_from") <= F.col(f"d.{at}")) & (F.col("m.valid_to").isNull() | (F.col("m.valid_to") > F.col(f"d.{at}")))
    for k in keys or []:
        inside = (F.col(f"d.{k}") == F.col(f"m.{k}")) & inside
    kept = ["d.*", *(f"m.{c}" for c in members.columns if c not in dates.columns)]
    if keys:
        return dates.alias("d").join(members.alias("m"), inside).select(*kept)
    span = dates.agg(F.min(F.date_trunc("month", at)).alias("first"), F.max(F.date_trunc("month", at)).alias("last"))  # one row
    start = F.greatest(F.date_trunc("month", "valid_from"), F.col("first"))
    stop = F.least(F.date_trunc("month", F.coalesce("valid_to", "last")), F.col("last"))
    months = F.when(start <= stop, F.sequence(start, stop, F.expr("INTERVAL 1 MONTH")))
    dealt = members.join(F.broadcast(span), F.col("valid_from") < F.col("last") + F.expr("INTERVAL 1 MONTH")).withColumn("__month", F.explode(months)).drop("first", "last")
    dated = dates.withColumn("__at_month", F.date_trunc("month", at))
    met = dated.alias("d").join(dealt.alias("m"), (F.col("d.__at_month") == F.col("m.__month")) & inside)
    return met.select(*kept).drop("__at_month", "__month")


def numbered(df: DataFrame, order: str, name: str, by: str | None = None, buckets: int = 200) -> DataFrame:
    """df with row numbers from 1 in the order of a number, date or instant, per group of `by` if given, without one task for all rows.

    Quantiles of `order` cut the rows into buckets; rows are numbered within each and take the sum of the smaller buckets'
    counts, which are `buckets` rows for each group. Equal values share a bucket; rows without a value come first.
    """
    value = F.col(order).cast("double") if dict(df.dtypes)[order] in ("double", "float", "int", "bigint", "smallint", "tinyint") else F.col(order).cast("timestamp").cast("double")
    cuts = sorted(set(df.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] or []))
    bucket = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (value > c).cast("int")) if cuts else F.lit(0)
    rows = df.withColumn("__bucket", F.coalesce(bucket, F.lit(-1)))
    groups = [by] if by else []
    counts = rows.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__count"))
    before = F.coalesce(F.sum("__count").over(W.partitionBy(*groups).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(g).alias("__by") for g in groups), F.col("__bucket").alias("__at"), before.alias("__before"))
    same = F.col("__bucket") == F.col("__at")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("__by"))
    place = F.row_number().over(W.partitionBy(*groups, "__bucket").orderBy(order)) + F.col("__before")
    return rows.join(offsets, same).withColumn(name, place).drop("__bucket", "__at", "__before", "__by")



def _settled(df: DataFrame) -> list[Column]:
    """An order of whole rows, for rows that nothing else tells apart."""
    return [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))]


def dedup_keep_last(df: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The row of each key that arrived last; of rows that arrived together, the same one whatever the order of the input."""
    w = W.partitionBy(*key).orderBy(F.desc(sequence), *_settled(df))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_counted(df: DataFrame, key: list[str], sequence: str) -> tuple[DataFrame, int]:
    """dedup_keep_last, and how many rows it drops (one aggregation over the keys)."""
    extra = df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return dedup_keep_last(df, key, sequence), int(extra)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row, and how many rows are too many."""
    return df.groupBy(*key).count().where("count > 1").select(*key, (F.col("count") - 1).alias("extra"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """existing with the rows of new added by key; a known key is replaced, or kept when update is false.

    Of several new rows of a key one is taken, the same whatever the order of the input."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = F.desc("__new") if update else F.asc("__new")
    return both.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order, *_settled(existing)))).where("__n = 1").drop("__n", "__new")


def wide_close(prices: DataFrame, symbols: list[str], field: str = "adj_close") -> DataFrame:
    return prices.groupBy("ts").pivot("symbol", symbols).agg(F.first(field))


def unpivot_features(df: DataFrame, names: list[str]) -> DataFrame:
    return df.unpivot(["symbol", "ts", "available_at"], names, "name", "value")


def pivot_features(long: DataFrame, names: list[str]) -> DataFrame:
    """One row per symbol and ts with a column for each name; of repeated values the one that became available last, then the largest."""
    known = long.where("value IS NOT NULL")
    order = F.struct("available_at", "value") if "available_at" in long.columns else F.col("value")
    return long.select("symbol", "ts").distinct().join(known.groupBy("symbol", "ts").pivot("name", names).agg(F.max_by("value", order)), ["symbol", "ts"], "left")


def page(df: DataFrame, order: list[str | Column], limit: int = 500, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("limit must lie between 1 and 10000, and offset not below 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[str | Column], limit: int = 500, offset: int = 0) -> DataFrame:
    """A page whose rows also carry the number of all rows."""
    return page(df, order, limit, offset).withColumn("total", F.lit(df.count()))


def coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows, values and share of values per feature."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))


class JoinError(ValueError):
    """A join that should be one to one is not."""


def one_to_one(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """left joined with right by key; a key that repeats on either side is refused."""
    for side, df in (("left", left), ("right", right)):
        if not duplicate_keys(df, key).isEmpty():
            raise JoinError(f"keys repeat on the {side}")
    return left.join(right, key, how)


def newest_rows(df: DataFrame, n: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """The n newest rows of each group."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")


class UniverseError(ValueError):
    """No symbol belongs to the universe at the instant asked for."""


def resolve_universe(bars: DataFrame, symbols: list[str] | None = None, members: DataFrame | None = None, at: str | None = None) -> tuple[DataFrame, str]:
    """(symbols, how): the symbols given, else the members at an instant, else all symbols that are stored.

    how is explicit, point_in_time or survivors; the last applies today's symbols to all of the past.
    """
    if symbols:
        names = sorted({s.strip().upper() for s in symbols if s.strip()})
        return bars.sparkSession.createDataFrame([(s,) for s in names], "symbol string"), "explicit"
    if members is not None:
        when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        held = members.where((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when))).select("symbol").distinct()
        if held.isEmpty():
            raise UniverseError(f"no members at {at}")
        return held, "point_in_time"
    return bars.select("symbol").distinct(), "survivors"

"""The hard schema gate before a load: types, order, keys and exact numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .quality import SchemaError, require_columns


def to_decimal(x: Column, places: int = 8, digits: int = 20) -> Column:
    """x as DECIMAL(digits, places), rounded half to even from the shortest text of the number; NaN and infinite become null, overflow is an error."""
    number = x.cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    exact = F.bround(finite.cast("string").try_cast("decimal(38,18)"), places).try_cast(f"decimal({digits},{places})")
    return F.when(finite.isNotNull(), F.coalesce(exact, F.raise_error(F.concat(F.lit("no room for "), finite.cast("string"))).cast(f"decimal({digits},{places})")))


def load_gated(df: DataFrame, target: str, quarantine: str, required: list[str], numeric: list[str] = (), instants: list[str] = ()) -> DataFrame:
    """Appends df to the Parquet table at target if every cell of the numeric columns (double) and instants (timestamp) can be read, and returns what was loaded.

    One pass over df coerces, marks the cells that became null and writes the rows aside. If there are any, nothing is loaded:
    the rows concerned go to the table at quarantine with `unread`, the names of their cells, and SchemaError tells the
    counts. Nulls stay nulls. A missing required column is refused before any reading; an optional one may be missing.
    """
    require_columns(df, list(required))
    kinds = {c: "double" for c in numeric if c in df.columns} | {c: "timestamp" for c in instants if c in df.columns}
    raw = df.withColumns({f"__raw_{c}": F.col(f"`{c}`") for c in kinds})
    typed = raw.withColumns({c: F.col(f"__raw_{c}").try_cast(kind) for c, kind in kinds.items()})
    lost = {c: F.col(f"__raw_{c}").isNotNull() & F.col(f"`{c}`").isNull() for c in kinds}
    unread = F.filter(F.array(*(F.when(x, F.lit(c)) for c, x in lost.items())).cast("array<string>"), lambda c: c.isNotNull())
    flagged = typed.withColumn("unread", unread)
    aside = f"{target.rstrip('/')}_staging/{uuid.uuid4().hex}"
    flagged.write.parquet(aside)
    rows = df.sparkSession.read.schema(flagged.schema).parquet(aside)
    # counted from the one column: an Observation would leave the session unable to run closures of fitted trees
    bad = {r.c: r.n for r in rows.select(F.explode("unread").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    if bad:
        kept = [F.col(f"__raw_{c}").cast("string").alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns]
        rows.where(F.size("unread") > 0).select(*kept, "unread").write.mode("append").parquet(quarantine)
        raise SchemaError("cells that cannot be read: " + ", ".join(f"{c} {n}" for c, n in sorted(bad.items())))
    rows = rows.select(*(F.col(f"`{c}`") for c in df.columns))
    rows.write.mode("append").parquet(target)
    return rows


def out_of_order(df: DataFrame, entity: str = "symbol", time: str = "ts", arrival: str = "arrived") -> DataFrame:
    """Rows whose time lies before that of the row which arrived just before, per entity."""
    before = F.lag(time).over(W.partitionBy(entity).orderBy(arrival))
    return df.withColumn("__before", before).where(F.col(time) < F.col("__before")).drop("__before")


def assert_monotonic(df: DataFrame, entity: str = "symbol", time: str = "ts", arrival: str = "arrived", strict: bool = False) -> DataFrame:
    """df, if time never goes back (strict: always goes on) in the order of arrival; else SchemaError with the first cases."""
    before = F.lag(time).over(W.partitionBy(entity).orderBy(arrival))
    wrong = F.col(time) <= F.col("__before") if strict else F.col(time) < F.col("__before")
    cases = df.withColumn("__before", before).where(wrong).orderBy(entity, arrival).select(F.col(entity).cast("string"), F.col(time).cast("string")).limit(5).collect()
    if cases:
        raise SchemaError("time goes back: " + "; ".join(f"{a} at {t}" for a, t in cases))
    return df


def normalised(df: DataFrame, entity: str = "symbol", time: str = "ts", unique: bool = True) -> DataFrame:
    """df with time as a timestamp (UTC session), and refused if a time cannot be read, is null, or repeats within an entity."""
    at = F.col(time).try_cast("timestamp")
    bad = df.where(at.isNull()).count()
    if bad:
        raise SchemaError(f"{bad} rows without a readable {time}")
    out = df.withColumn(time, at)
    if unique:
        cases = out.groupBy(entity, time).count().where("count > 1").orderBy(entity, time).limit(5).collect()
        if cases:
            raise SchemaError("repeated keys: " + "; ".join(f"{r[0]} at {r[1]}" for r in cases))
    return out

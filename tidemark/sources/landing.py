"""Landing files: daily bars and macro series as CSV, with the instants at which they became knowable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive

#: Time zone and local close of each session.
SESSIONS = {
    "us_equity": ("America/New_York", 16, 0),
    "lse": ("Europe/London", 16, 30),
    "tse": ("Asia/Tokyo", 15, 0),
    "set": ("Asia/Bangkok", 16, 30),
}
#: The session of a symbol's suffix; all others trade in the first.
SUFFIXES = {"us": "us_equity", "uk": "lse"}
#: Days from an observation to its publication.
PUBLICATION_LAG = {
    "DGS10": 1, "DGS2": 1, "DGS3MO": 1, "T10Y2Y": 1, "T10Y3M": 1, "VIXCLS": 1, "BAMLH0A0HYM2": 2, "DTWEXBGS": 7, "DFF": 2,
    "UNRATE": 45, "CPIAUCSL": 45, "INDPRO": 45, "PAYEMS": 45, "UMCSENT": 45, "GDPC1": 120,
}
DEFAULT_LAG = 45
#: Name, frequency and unit of each known series.
SERIES = {
    "DGS10": ("10-Year Treasury Constant Maturity Rate", "daily", "percent"),
    "DGS2": ("2-Year Treasury Constant Maturity Rate", "daily", "percent"),
    "DGS3MO": ("3-Month Treasury Constant Maturity Rate", "daily", "percent"),
    "T10Y2Y": ("10-Year minus 2-Year Treasury Spread", "daily", "percent"),
    "T10Y3M": ("10-Year minus 3-Month Treasury Spread", "daily", "percent"),
    "VIXCLS": ("CBOE Volatility Index: VIX", "daily", "index"),
    "BAMLH0A0HYM2": ("ICE BofA US High Yield Index Option-Adjusted Spread", "daily", "percent"),
    "DTWEXBGS": ("Nominal Broad U.S. Dollar Index", "daily", "index"),
    "DFF": ("Federal Funds Effective Rate", "daily", "percent"),
    "UNRATE": ("Unemployment Rate", "monthly", "percent"),
    "CPIAUCSL": ("CPI for All Urban Consumers: All Items", "monthly", "index"),
    "INDPRO": ("Industrial Production: Total Index", "monthly", "index"),
    "PAYEMS": ("All Employees, Total Nonfarm", "monthly", "thousands"),
    "UMCSENT": ("University of Michigan: Consumer Sentiment", "monthly", "index"),
    "GDPC1": ("Real Gross Domestic Product", "quarterly", "billions_chained_2017"),
}


class LandingError(ValueError):
    """A landing file does not have the columns or dates that it should."""


def session_of(symbol: Column) -> Column:
    """The session in which a symbol trades, by its suffix."""
    suffix = F.lower(F.regexp_extract(symbol, r"\.([^.]*)$", 1))
    found = F.lit("us_equity")
    for k, session in SUFFIXES.items():
        found = F.when(suffix == k, session).otherwise(found)
    return found


def close_instant(day: Column, session: Column | str) -> Column:
    """The UTC instant of a session's close on a day. A column gives null for an unknown session, a name is refused. The session time zone must be UTC."""
    if isinstance(session, str) and session not in SESSIONS:
        raise LandingError(f"unknown session {session}; known are {', '.join(SESSIONS)}")
    session = F.lit(session) if isinstance(session, str) else session
    found = F.lit(None).cast("timestamp")
    for name, (zone, hour, minute) in SESSIONS.items():
        local = F.date_trunc("day", day.cast("timestamp")) + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
        found = F.when(session == name, F.to_utc_timestamp(local, zone)).otherwise(found)
    return found


def published_at(day: Column, lag_days: Column | int) -> Column:
    """13:30 UTC so many days after the observation; a negative lag is refused."""
    if isinstance(lag_days, int):
        if lag_days < 0:
            raise ValueError("a publication lag is not negative")
        lag_days = F.lit(lag_days)
    wait = F.make_dt_interval(days=lag_days, hours=F.lit(13), mins=F.lit(30))
    return F.when(F.assert_true(lag_days >= 0, F.lit("a publication lag is not negative")).isNull(), F.date_trunc("day", day.cast("timestamp")) + wait)


def lag_of(code: Column) -> Column:
    """Publication lag in days of a series; unknown series have the default."""
    found = F.lit(DEFAULT_LAG)
    for k, days in PUBLICATION_LAG.items():
        found = F.when(F.upper(code) == k, days).otherwise(found)
    return found


def with_metadata(rows: DataFrame, code: str = "code") -> DataFrame:
    """rows with name, frequency, units and lag_days of their series, and known: whether it is in the table.

    Codes count in capitals. An unknown series is taken as monthly with the default lag, and has neither name nor unit.
    """
    table = rows.sparkSession.createDataFrame([(k, *v) for k, v in SERIES.items()], "__code string, name string, frequency string, units string")
    met = rows.join(F.broadcast(table), F.upper(F.col(code)) == F.col("__code"), "left")
    known = F.col("__code").isNotNull()
    return met.withColumns({"frequency": F.coalesce("frequency", F.lit("monthly")), "lag_days": lag_of(F.col(code)), "known": known}).drop("__code")


def period_key(ts: Column, frequency: str) -> Column:
    """Text that is equal for the instants of one period: day, week (ISO), month, quarter or year."""
    if frequency == "week":
        thursday = F.date_add(F.date_trunc("week", ts).cast("date"), 3)
        return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if frequency == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    patterns = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    if frequency not in patterns:
        raise ValueError(f"unknown frequency {frequency}")
    return F.date_format(ts, patterns[frequency])


def _entity() -> Column:
    """The file's name without folder and ending, in capitals: the symbol or code that it holds."""
    return F.upper(F.regexp_replace(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1), r"(?i)\.csv$", ""))


LINE_END = "\r\n|\n|\r"
PRICES = {"date", "open", "high", "low", "close"}


def _text() -> Column:
    return F.regexp_replace(F.decode("content", "UTF-8"), "^\uFEFF", "")


def _names(header: Column) -> Column:
    return F.transform(F.split(header, ","), lambda c: F.lower(F.trim(F.regexp_replace(c, '"', ""))))


def csv_cells(payloads: DataFrame, required: set[str]) -> DataFrame:
    """entity, arrived and cells of each line of CSV payloads; cells: column name -> text, by the header of the line's own file.

    Names are trimmed and lower-cased; empty cells and empty lines are left out; a cell may stand in double quotes. arrived
    (fetched_at, entity, line) orders lines as they came: files by time, lines by their number. A payload whose header
    lacks a required column raises an error, which names the first that is missing.
    """
    lines = payloads.select("entity", "fetched_at", F.split(_text(), LINE_END).alias("lines"))
    headed = lines.select("entity", "fetched_at", "lines", _names(F.col("lines")[0]).alias("names"))
    lacking = F.array_except(F.array(*(F.lit(c) for c in sorted(required))), "names")
    checked = F.when(F.size(lacking) == 0, F.col("names")).otherwise(F.raise_error(F.concat("entity", F.lit(": no column "), lacking[0])).cast("array<string>"))
    rows = headed.select("entity", "fetched_at", checked.alias("names"), F.posexplode("lines").alias("line", "text")).where("line > 0 AND trim(text) <> ''")
    parts = F.transform(F.split("text", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    width = F.least(F.size("names"), F.size("parts"))
    pairs = F.filter(F.arrays_zip(F.slice("names", 1, width).alias("key"), F.slice("parts", 1, width).alias("value")), lambda x: x["value"] != "")
    return rows.withColumn("parts", parts).select("entity", F.struct("fetched_at", "entity", "line").alias("arrived"), F.map_from_entries(pairs).alias("cells"))


def parse_prices(payloads: DataFrame) -> DataFrame:
    """Canonical bars, and arrived, of CSV payloads with Date, Open, High, Low, Close and perhaps Volume in any order, one symbol each.

    Numbers that cannot be read are null, and rows without a full set of prices are left out; an unreadable date is an
    error. The close serves as adjusted close.
    """
    rows = csv_cells(payloads, PRICES)
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    day = F.coalesce(cell("date").try_cast("date"), F.raise_error(F.concat(F.lit("unreadable date "), F.coalesce(cell("date"), F.lit("")))).cast("date"))
    rows = rows.select(F.col("entity").alias("symbol"), day.cast("timestamp").alias("ts"), *(cell(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")), "arrived")
    rows = rows.withColumn("available_at", close_instant(F.col("ts"), session_of(F.col("symbol")))).withColumn("adj_close", F.col("close"))
    return rows.dropna(subset=["open", "high", "low", "close"]).select("symbol", "ts", "available_at", "open", "high", "low", "close", "adj_close", "volume", "arrived")


def read_prices(spark: SparkSession, path: str, arrived: bool = False) -> DataFrame:
    """Canonical bars of landing CSV files, one symbol a file (named after it), each by its own header; see parse_prices.

    A file is one row until it is parsed, so it has to fit a task. With arrived the rows keep the order in which they came.
    """
    files = archive.read_files(spark, path, "landing", "prices")
    header = F.split(_text(), LINE_END, 2)[0]
    lacking = F.array_except(F.array(*(F.lit(c) for c in sorted(PRICES))), _names(header))
    short = files.select("entity", lacking.alias("lacking")).where(F.size("lacking") > 0).first()
    if short:
        raise LandingError(f"{short.entity}: no column {', '.join(short.lacking)}")
    rows = parse_prices(files)
    return rows if arrived else rows.drop("arrived")


def read_close_only(spark: SparkSession, path: str) -> DataFrame:
    """Canonical bars of CSV files with a date and a close alone: all four prices are the close, the volume is null."""
    rows = _pairs(spark, path).where("value is not null")
    price = F.col("value")
    return rows.select(F.col("code").alias("symbol"), "ts", close_instant(F.col("ts"), "us_equity").alias("available_at"), *(price.alias(c) for c in ("open", "high", "low", "close", "adj_close")), F.lit(None).cast("double").alias("volume"))


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    """(code, ts, value) by position: headers have changed over time, so lines without a date in front are left out."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).select(_entity().alias("code"), F.trim(parts[0]).try_cast("date").alias("day"), F.get(parts, F.lit(1)).alias("x"))
    return rows.where("day is not null").select("code", F.col("day").cast("timestamp").alias("ts"), F.when(F.trim("x") != ".", F.trim("x").try_cast("double")).alias("value"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """code, ts, available_at, value of CSV files with a date and a value, one series a file; a dot is a missing value."""
    rows = _pairs(spark, path)
    return rows.select("code", "ts", published_at(F.col("ts"), lag_of(F.col("code"))).alias("available_at"), "value")

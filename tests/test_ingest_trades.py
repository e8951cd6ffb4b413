"""Raw archive, landing files by their own headers, the schema gate, point-in-time views and trade results."""

import datetime as dt
import random
from collections import deque
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.functions.causal import LookAheadError
from tidemark.operators import gate, pit, quality, trades
from tidemark.sources import archive, landing

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def test_files_are_parsed_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.us.csv").write_text("Date,Open,High,Low,Close,Volume\r\n2024-01-02,1,4,0.5,3,10\r\n\r\n")
    (tmp_path / "b.us.csv").write_text('﻿"Date",Close,High,Low,Open,Volume,Extra\n2024-01-02,3,4,0.5,1,"10",x\n2024-01-03,3,4,0.5\n')
    (tmp_path / "c.us.csv").write_text("close , low,high,open,DATE\n3,0.5,4,1,2024-01-02\n")
    (tmp_path / "d.us.csv").write_text("Date,Open,High,Low,Close\n")
    got = {r.symbol: (r.open, r.high, r.low, r.close, r.volume) for r in landing.read_prices(spark, str(tmp_path)).collect()}
    assert got == {"A.US": (1, 4, 0.5, 3, 10), "B.US": (1, 4, 0.5, 3, 10), "C.US": (1, 4, 0.5, 3, None)}


def test_two_swapped_lines_fail_the_gate(spark, tmp_path):
    days = ["02", "03", "05", "04", "08"]
    (tmp_path / "bad.us.csv").write_text("Date,Open,High,Low,Close\n" + "".join(f"2024-01-{d},1,1,1,1\n" for d in days))
    (tmp_path / "good.us.csv").write_text("Date,Open,High,Low,Close\n" + "".join(f"2024-01-{d},1,1,1,1\n" for d in sorted(days)))
    rows = landing.read_prices(spark, str(tmp_path), arrived=True)
    report = {(r.entity, r.check_name): r.status for r in quality.price_report(rows, arrival="arrived").collect()}
    assert report["BAD.US", "monotonic_time"] == "FAIL" and report["GOOD.US", "monotonic_time"] == "PASS"
    with pytest.raises(quality.SchemaError, match="BAD.US at 2024-01-04"):
        gate.assert_monotonic(rows)
    gate.assert_monotonic(rows.where("symbol = 'GOOD.US'"), strict=True)
    assert [r.ts.day for r in gate.out_of_order(rows).collect()] == [4]
    status = {r.symbol: r.status for r in jobs.ingest_prices(spark, str(tmp_path), str(tmp_path / "table")).collect()}
    assert status == {"BAD.US": "failed", "GOOD.US": "loaded"}


def test_archive_holds_bytes_under_their_address(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "archive")
    src.mkdir()
    (src / "spy.us.csv").write_text("Date,Open,High,Low,Close\n2024-01-02,1,2,0.5,1.5\n")
    assert jobs.archive_prices(spark, str(src), root) == 1
    assert jobs.archive_prices(spark, str(src), root) == 0  # again: nothing new
    first = {r.symbol: r.n_loaded for r in jobs.ingest_archive(spark, root, str(tmp_path / "t1")).collect()}
    bars = spark.read.parquet(str(tmp_path / "t1")).collect()
    assert first == {"SPY.US": 1} and bars == landing.read_prices(spark, str(src)).withColumn("month", F.lit(202401)).select(*spark.read.parquet(str(tmp_path / "t1")).columns).collect()
    (row,) = archive.read(spark, root, "landing", "prices").collect()
    assert bytes(row.content) == (src / "spy.us.csv").read_bytes() and row.size == len(row.content)
    assert row.address == f"landing/prices/SPY.US/{row.fetched_at:%Y-%m-%d}/{row.sha256[:16]}.csv"
    assert archive.read(spark, root, "landing", "other").count() == 0
    # a correction comes later and counts
    later = [("landing", "prices", "SPY.US", row.fetched_at + DAY, "text/csv", bytearray(b"Date,Open,High,Low,Close\n2024-01-02,1,2,0.5,1.75\n"))] * 2
    assert archive.write(spark.createDataFrame(later, "provider string, dataset string, entity string, fetched_at timestamp, content_type string, content binary"), root) == 1
    jobs.ingest_archive(spark, root, str(tmp_path / "t1"))
    assert [r.close for r in spark.read.parquet(str(tmp_path / "t1")).collect()] == [1.75]
    bad = str(tmp_path / "altered")
    archive.read(spark, root).withColumn("content", F.encode(F.lit("x"), "UTF-8")).write.partitionBy("provider", "dataset").parquet(bad)
    with pytest.raises(Exception, match="altered bytes"):
        archive.read(spark, bad).collect()
    with pytest.raises(Exception, match="no content"):
        archive.write(spark.createDataFrame([("p", "d", "e", T0, "x", None)], "provider string, dataset string, entity string, fetched_at timestamp, content_type string, content binary"), root)


def test_one_bad_cell_stops_the_load(spark, tmp_path):
    target, held = str(tmp_path / "t"), str(tmp_path / "q")
    schema = "symbol string, ts string, close string, note string"
    good = spark.createDataFrame([("a", "2024-01-01", "1.5", "x"), ("a", "2024-01-02 10:00:00", None, None)], schema)
    loaded = gate.load_gated(good, target, held, ["symbol", "ts"], ["close", "absent"], ["ts"])
    assert dict(loaded.dtypes)["close"] == "double" and dict(loaded.dtypes)["ts"] == "timestamp"
    assert spark.read.parquet(target).count() == 2
    bad = good.union(spark.createDataFrame([("b", "2024-01-03", "1,5", "y"), ("c", "soon", "n/a", "z")], schema))
    with pytest.raises(quality.SchemaError, match="close 2, ts 1"):
        gate.load_gated(bad, target, held, ["symbol", "ts"], ["close"], ["ts"])
    assert spark.read.parquet(target).count() == 2
    kept = {r.symbol: (r.ts, r.close, r.note, r.unread) for r in spark.read.parquet(held).collect()}
    assert kept == {"b": ("2024-01-03", "1,5", "y", ["close"]), "c": ("soon", "n/a", "z", ["close", "ts"])}
    with pytest.raises(quality.SchemaError, match="missing columns"):
        gate.load_gated(good, target, held, ["volume"])


def test_normalised_index(spark):
    rows = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02")], "symbol string, ts string")
    assert dict(gate.normalised(rows).dtypes)["ts"] == "timestamp"
    with pytest.raises(quality.SchemaError, match="repeated"):
        gate.normalised(rows.union(rows))
    assert gate.normalised(rows.union(rows), unique=False).count() == 4
    with pytest.raises(quality.SchemaError, match="readable"):
        gate.normalised(spark.createDataFrame([("a", "?")], "symbol string, ts string"))


def test_decimals_are_rounded_half_to_even(spark):
    values = [0.125, 0.375, -0.125, 2.675, 1e-7, 1234567.891, None, float("nan"), float("inf"), 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(gate.to_decimal(F.col("x"), 2)).collect()]
    want = [None if v is None or v != v or abs(v) == float("inf") else Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_EVEN) for v in values]
    assert got == want
    with pytest.raises(Exception, match="no room"):
        spark.createDataFrame([(1e13,)], "x double").select(gate.to_decimal(F.col("x"), 8)).collect()


def bars(spark):
    rows = [(s, T0 + i * DAY, T0 + i * DAY + dt.timedelta(hours=21), float(10 * k + i)) for k, s in enumerate("ab") for i in range(10)]
    rows.append(("a", T0 + 3 * DAY, T0 + 6 * DAY, 99.0))  # a revision
    rows.append(("late", T0, T0 + 9 * DAY, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, available_at timestamp, close double")


def test_point_in_time_view(spark):
    df = bars(spark)
    view = pit.PointInTimeView(df, T0 + 5 * DAY)
    assert view.rows().count() == 10 and view.rows().where("available_at > TIMESTAMP '2024-01-06'").count() == 0
    assert {r.symbol: r.close for r in view.latest().collect()} == {"a": 4.0, "b": 14.0}
    assert {r.symbol: r.values for r in view.values("close", 3).collect()} == {"a": [2.0, 3.0, 4.0], "b": [12.0, 13.0, 14.0]}
    assert {r.symbol: r.close for r in view.value_at(T0 + 3 * DAY, "close").collect()} == {"a": 3.0, "b": 13.0}
    assert {r.symbol: r.close for r in pit.PointInTimeView(df, "2024-01-08").value_at(T0 + 3 * DAY, "close").collect()} == {"a": 99.0, "b": 13.0}
    assert [r.symbol for r in view.symbols().orderBy("symbol").collect()] == ["a", "b"]
    assert view.of("b").tail(2).count() == 2 and view.earlier(T0 + DAY).rows().count() == 2
    for peek in (lambda: view.value_at(T0 + 6 * DAY, "close"), lambda: view.earlier(T0 + 6 * DAY), lambda: view.require_history(6), lambda: view.of("late").require_history(1), lambda: pit.PointInTimeView(df.drop("available_at"), T0)):
        with pytest.raises(LookAheadError):
            peek()
    assert view.require_history(5).count() == 10
    with pytest.raises(ValueError):
        view.tail(0)
    with pytest.raises(KeyError):
        view.values("volume", 1)
    assert pit.PointInTimeView(df, T0).rows().count() == 0


def test_the_view_filter_reaches_the_scan(spark, tmp_path):
    bars(spark).write.parquet(str(tmp_path / "bars"))
    view = pit.PointInTimeView(spark.read.parquet(str(tmp_path / "bars")), T0 + 5 * DAY)
    plan = view.of("a").latest()._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "LessThanOrEqual(available_at" in pushed and "symbol" in pushed


def fills_of(rng, n):
    return [(s, T0 + rng.randint(0, 50) * DAY, i, rng.choice([-7, -3, -1, 0, 1, 2, 5]), float(rng.randint(50, 150))) for s in "ab" for i in range(n)]


FILLS = "symbol string, ts timestamp, seq int, quantity int, price double"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trades_equal_a_loop(spark, seed):
    rows = fills_of(random.Random(seed), 60)
    df = spark.createDataFrame(rows, FILLS).repartition(3)
    trips, results = [], {}
    for s in "ab":
        open_units, held, cost = deque(), 0, 0.0
        for _, ts, seq, q, price in sorted((r for r in rows if r[0] == s and r[3]), key=lambda r: (r[1], r[2])):
            side, left, realised = (1 if q > 0 else -1), abs(q), 0.0
            if held * q < 0:
                realised = min(abs(q), abs(held)) * (price - cost) * (1 if held > 0 else -1)
            while left and open_units and open_units[0][0] != side:
                was, n, at, opened = open_units[0]
                take = min(n, left)
                trips.append((s, was, float(take), at, opened, ts, price, was * (price - opened) * take))
                left -= take
                open_units[0] = (was, n - take, at, opened)
                if n == take:
                    open_units.popleft()
            if left:
                open_units.append((side, left, ts, price))
            after = held + q
            cost = (cost * abs(held) + price * abs(q)) / abs(after) if held * q >= 0 else price if held * after < 0 else cost if after else 0.0
            held = after
            results[s, seq] = (realised, float(after), cost)

    def total(found):  # stretches of one opening and one closing fill may be cut
        out = {}
        for s, side, n, at, opened, ts, price, pnl in found:
            key = (s, side, at, opened, ts, price)
            out[key] = tuple(a + b for a, b in zip(out.get(key, (0, 0)), (n, pnl)))
        return out

    got = trades.round_trips(df)
    assert total(map(tuple, got.collect())) == total(trips)  # whole numbers
    booked = trades.fill_results(df)
    assert {(r.symbol, r.seq): (r.realised, r.position, r.average_cost) for r in booked.collect()} == {k: pytest.approx(v) for k, v in results.items()}
    for r in trades.trade_metrics(booked).collect():
        own = [v[0] for (s, _), v in results.items() if s == r.symbol]
        assert r.n_trades == len(own) and r.trade_win_rate == pytest.approx(sum(x > 0 for x in own) / len(own))
        assert r.trade_profit_factor == pytest.approx(sum(x for x in own if x > 0) / -sum(x for x in own if x < 0))


def test_no_fills(spark):
    none = spark.createDataFrame([("a", T0, 0, 0, 1.0), ("a", T0, 1, None, 1.0)], FILLS)
    assert trades.round_trips(none).count() == 0 and trades.fill_results(none).count() == 0


def test_series_have_their_metadata(spark):
    rows = spark.createDataFrame([("dgs10",), ("GDPC1",), ("other",), (None,)], "code string")
    got = {r.code: (r.name, r.frequency, r.units, r.lag_days, r.known) for r in landing.with_metadata(rows).collect()}
    assert got["dgs10"] == ("10-Year Treasury Constant Maturity Rate", "daily", "percent", 1, True)
    assert got["GDPC1"][1:] == ("quarterly", "billions_chained_2017", 120, True)
    assert got["other"] == got[None] == (None, "monthly", None, 45, False)
    assert set(landing.SERIES) == set(landing.PUBLICATION_LAG)
    with pytest.raises(landing.LandingError, match="unknown session"):
        landing.close_instant(F.col("ts"), "nowhere")


def test_required_columns_and_dropped_rows_are_told(spark):
    from tidemark.operators import features, relational

    df = bars(spark)
    with pytest.raises(quality.SchemaError, match="high, low, volume"):
        features.price_features(df, "close")
    kept, dropped = relational.dedup_counted(df, ["symbol", "ts"], "available_at")
    assert dropped == 1 and kept.count() == df.count() - 1 and kept.where("close = 99").count() == 1
    assert relational.dedup_counted(df.limit(0), ["symbol", "ts"], "available_at")[1] == 0

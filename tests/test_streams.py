"""Streams against their batch twins: shuffled files, late rows, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import keyed
from tidemark.streaming.bars import gated_bars, tick_bars
from tidemark.streaming.resolution import resolve_forecasts

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    was = spark.conf.get(keyed.PROVIDER)
    spark.conf.set(keyed.PROVIDER, keyed.ROCKSDB)
    yield
    spark.conf.set(keyed.PROVIDER, was)


def drop_files(spark, rows, schema, path, parts):
    """rows in so many files, in order."""
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, path, mode="append"):
    """Reads all there is, into Parquet files by micro-batch number; can be run again after more has come."""

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


FORECASTS = "model string, symbol string, ts timestamp, target_ts timestamp, y_pred double"
LABELS = "symbol string, target_ts timestamp, label_at timestamp, y_true double"


def test_forecasts_meet_labels_on_streams_as_on_tables(spark, tmp_path):
    rng, day = random.Random(3), dt.timedelta(days=1)
    forecasts, labels = [], []
    for d in range(60):
        for s in "ab":
            ts, target = T0 + d * day, T0 + (d + 1) * day
            forecasts += [(m, s, ts, target, rng.random()) for m in ("x", "y")]
            wait = rng.choice([0, 1, 5, 9, 14, None])  # 14 days: too late; None: never
            if wait is not None:
                labels.append((s, target, target + wait * day, rng.random()))
    forecasts.append(("bad", "a", T0 + day, T0, 1.0))  # target before the decision
    forecasts.append(("end", "z", T0 + 89 * day, T0 + 90 * day, 0.0))
    labels.sort(key=lambda r: r[2] + dt.timedelta(hours=rng.randint(0, 40)))  # up to 40 hours out of order
    labels.append(("z", T0 + 90 * day, T0 + 90 * day, 0.5))
    f, lab = f"{tmp_path}/f", f"{tmp_path}/l"

    def stream():
        return resolve_forecasts(source(spark, f, FORECASTS), source(spark, lab, LABELS))

    drop_files(spark, forecasts[:100], FORECASTS, f, 4)
    drop_files(spark, labels[:30], LABELS, lab, 3)
    run(stream(), tmp_path)
    first = spark.read.parquet(f"{tmp_path}/out").count()
    drop_files(spark, forecasts[100:], FORECASTS, f, 4)
    drop_files(spark, labels[30:], LABELS, lab, 3)
    run(stream(), tmp_path)  # a restart from the checkpoint
    run(stream(), tmp_path)  # and one without anything new
    got = [tuple(r)[:-1] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    batch = resolve_forecasts(spark.createDataFrame(forecasts, FORECASTS), spark.createDataFrame(labels, LABELS))
    want = [tuple(r) for r in batch.collect()]
    assert first and len(want) == len(forecasts) - 1
    assert sorted(map(str, got)) == sorted(map(str, want))
    known = {(s, t): (y, at) for s, t, at, y in labels if at - t <= 10 * day}
    assert all((r[5], r[6]) == known.get((r[1], r[3]), (None, None)) for r in want)


def test_forecasts_as_of_leave_out_what_is_open(spark):
    day = dt.timedelta(days=1)
    forecasts = spark.createDataFrame([("m", s, T0, T0 + day, 0.1) for s in "abc"], FORECASTS)
    labels = spark.createDataFrame([("a", T0 + day, T0 + 2 * day, 1.0), ("b", T0 + day, T0 + 8 * day, 2.0)], LABELS)
    at = {k: {r.symbol: r.y_true for r in resolve_forecasts(forecasts, labels, as_of=T0 + k * day).collect()} for k in (1, 3, 9, 12)}
    assert at == {1: {}, 3: {"a": 1.0}, 9: {"a": 1.0, "b": 2.0}, 12: {"a": 1.0, "b": 2.0, "c": None}}


TICKS = "symbol string, ts timestamp, value double"


def test_bars_pass_the_gate_once_and_never_before_they_are_available(spark, tmp_path):
    rng = random.Random(5)
    minute = dt.timedelta(minutes=1)
    ticks = [(rng.choice("ab"), T0 + k * minute + dt.timedelta(seconds=rng.randint(0, 59)), float(k)) for k in range(1500)]
    ticks = sorted(ticks, key=lambda r: r[1] + rng.randint(0, 50) * minute)  # out of order, within the lateness
    ticks += [(None, T0 + 1499 * minute, 1.0), ("a", None, 1.0), ("a", T0 + 1499 * minute, None)]
    path = f"{tmp_path}/in"
    drop_files(spark, ticks[:700], TICKS, path, 5)
    run(gated_bars(source(spark, path, TICKS)), tmp_path)
    drop_files(spark, ticks[700:], TICKS, path, 5)
    run(gated_bars(source(spark, path, TICKS)), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    table = spark.createDataFrame(ticks, TICKS)
    want = gated_bars(table)
    assert want.count() > 30
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, want.collect()))
    every = {(r.symbol, r.start): r for r in tick_bars(table.dropna(), "1 hour").collect()}
    assert all(r.close == every[r.symbol, r.start].close and r.ticks == every[r.symbol, r.start].ticks for r in want.collect())
    # what had been read when a batch emitted: never less than a bar's availability
    order = [r[1] for r in ticks if all(r)]
    size = 140  # ticks in a file of the first run
    for r in got.where("batch < 5").collect():
        assert r.available_at <= max(order[: size * (r.batch + 1)])


ARRIVALS = "k string, part int, ingest_seq long, v double"


@pytest.mark.parametrize("seed", [1, 2])
def test_last_arrivals_of_shuffled_batches_equal_the_table(spark, tmp_path, rocksdb, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randint(0, 2), i, rng.random()) for i in range(200)]
    rows.append(("a", 0, None, 1.0))
    rng.shuffle(rows)
    path = f"{tmp_path}/in"
    drop_files(spark, rows[:120], ARRIVALS, path, 4)
    run(keyed.last_arrivals(source(spark, path, ARRIVALS), ["k", "part"]), tmp_path, "update")
    drop_files(spark, rows[120:], ARRIVALS, path, 4)
    run(keyed.last_arrivals(source(spark, path, ARRIVALS), ["k", "part"]), tmp_path, "update")
    state: dict = {}
    handed = spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect()
    for r in handed:  # a plain upsert, later batches over earlier ones
        assert (r.k, r.part) not in state or state[r.k, r.part][2] < r.ingest_seq
        state[r.k, r.part] = tuple(r)[:4]
    want = {(r.k, r.part): tuple(r) for r in keyed.last_arrivals(spark.createDataFrame(rows, ARRIVALS), ["k", "part"]).collect()}
    assert state == want and len(handed) > len(want)


def test_last_arrivals_need_their_state_store(spark, tmp_path):
    drop_files(spark, [("a", 0, 1, 1.0)], ARRIVALS, f"{tmp_path}/in", 1)
    with pytest.raises(ValueError, match="RocksDB"):
        keyed.last_arrivals(source(spark, f"{tmp_path}/in", ARRIVALS), ["k"])

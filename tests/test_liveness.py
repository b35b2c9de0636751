"""Tables that follow streams: replays after a failure before and after a snapshot is written, and writers at once."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from jobloom.plans import snapshots
from jobloom.streaming import liveness

AT = dt.datetime(2024, 3, 1)


@pytest.fixture
def table(spark):
    rows = [(k, "ab"[k % 2], f"u{k}", AT - dt.timedelta(days=k), k % 3 > 0, False) for k in range(90)]
    return spark.createDataFrame(rows, "id int, source string, url string, first_seen timestamp, active boolean, sweep_dead boolean")


def _land(spark, place, found, day, probes=(), runs=("a", "b")):
    at = AT + dt.timedelta(days=day)
    rows = [("found", "ab"[k % 2], f"u{k}", None, None, None, None, at) for k in found] + [("run", s, None, True, False, None, None, at) for s in runs]
    rows += [("probe", "ab"[k % 2], f"u{k}", None, None, True, again, at) for k, again in probes]
    spark.createDataFrame(rows, liveness.CHANGES).coalesce(1).write.mode("append").parquet(place)


def _run(spark, root):
    stream = spark.readStream.schema(liveness.CHANGES).parquet(f"{root}/landed")
    liveness.follow(stream, "crawls", root, "t", liveness.liveness([]), f"{root}/c", liveness.archived(["b"])).awaitTermination(120)


def _rows(spark, root):
    return sorted(map(tuple, snapshots.current(spark, root, "t").select("id", "active", "sweep_dead").collect()))


def _archive(spark, root):
    return sorted(r["id"] for r in spark.read.json(f"{root}/t-archive/*").select("id").collect())


def _twice(spark, root):
    _land(spark, f"{root}/landed", range(0, 90, 2), 0)
    _run(spark, root)
    _land(spark, f"{root}/landed", range(0, 90, 3), 9, probes=[(6, True), (12, False)], runs=("a",))
    _run(spark, root)


def test_replays_change_nothing(spark, table, tmp_path, monkeypatch):
    plain = str(tmp_path / "plain")
    snapshots.commit(table, plain, "t")
    _twice(spark, plain)
    wanted, gone = _rows(spark, plain), _archive(spark, plain)
    state = {k: (active, dead) for k, active, dead in wanted}
    assert state[6] == (False, True) and state[12] == (True, False) and 61 in gone and 2 not in gone and len(wanted) + len(gone) == 90

    # the driver dies before the snapshot is written, while it is, and when it is but the batch is not committed
    real = snapshots.commit
    for when in ("before", "while", "after"):
        root, fails = str(tmp_path / when), [True, True]

        def dying(df, place, name, tag=None, **more):
            if tag is None or not fails:
                return real(df, place, name, tag=tag, **more)
            fails.pop()
            if when == "while":
                df.limit(3).write.parquet(f"{place}/{name}/v={snapshots._claimed(spark, place, name)}.{tag}")
                fs, done = snapshots._folder(spark, f"{place}/{name}/v=2.{tag}/_SUCCESS")
                fs.delete(done, False)
            elif when == "after":
                real(df, place, name, tag=tag, **more)
            raise RuntimeError("the driver dies")

        snapshots.commit(table, root, "t")
        _land(spark, f"{root}/landed", range(0, 90, 2), 0)
        monkeypatch.setattr(snapshots, "commit", dying)
        fails.pop()
        with pytest.raises(Exception, match="dies"):
            _run(spark, root)
        monkeypatch.setattr(snapshots, "commit", real)
        _run(spark, root)
        _land(spark, f"{root}/landed", range(0, 90, 3), 9, probes=[(6, True), (12, False)], runs=("a",))
        _run(spark, root)
        assert _rows(spark, root) == wanted and _archive(spark, root) == gone
        assert len(snapshots._versions(spark, root, "t")) == 3


def test_a_day_is_written_once(spark, tmp_path):
    root, schema = str(tmp_path), "day string, n int, seq int"
    snapshots.commit(spark.createDataFrame([("d1", 1, 0)], schema), root, "days")
    for k, rows in enumerate(([("d1", 5, 1), ("d2", 7, 3), ("d2", 6, 2)], [("d2", 9, 1), ("d3", 8, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in{k}")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in{k}")
        liveness.follow(stream, f"s{k}", root, "days", liveness.first_written(["day"], ["seq"]), f"{root}/c{k}").awaitTermination(120)
    assert sorted(map(tuple, snapshots.current(spark, root, "days").collect())) == [("d1", 1, 0), ("d2", 6, 2), ("d3", 8, 1)]


def test_writers_at_once_take_numbers_of_their_own(spark, tmp_path):
    df = spark.range(1).select(F.col("id").cast("int"))
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: snapshots.commit(df, str(tmp_path), "t"), range(8)))
    assert sorted(numbers) == list(range(1, 9)) and len(snapshots._versions(spark, str(tmp_path), "t")) == 8

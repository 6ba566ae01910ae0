from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators.changes import ChangeLog, Conflict, within_spans
from siltstone.session import scratch_path
from siltstone.streaming.ingest import follow

T0 = datetime(2025, 1, 1)
DDL = "path string, at timestamp, h string"


def rows(spark, *items):
    return spark.createDataFrame([(p, None if t is None else T0 + timedelta(hours=t), h) for p, t, h in items], DDL)


def log(spark, root):
    return ChangeLog(spark, root, "k", "t", ["h"])


def append(target, frame):
    target.append(frame, F.col("path"), F.col("at"), {"h": F.col("h")})


def state(target):
    return {r["k"]: r["h"] for r in target.state().collect()}


def test_only_new_rows_each_run(spark):
    root = scratch_path(spark, "log")
    target = log(spark, root)
    append(target, rows(spark, ("a", 1, "x"), ("b", 1, "y"), ("a", 1, "x")))
    assert target.run() == 1
    assert state(target) == {"a": "x", "b": "y"}
    append(target, rows(spark, ("a", 3, "z"), ("b", 0, "late"), (None, 3, "q"), ("c", None, "q"), ("c", 3, None)))
    plan = target.plan()
    assert {r["h"] for r in target.planned_rows(plan).collect()} == {"z", "late"}
    assert target.run() == 2
    assert state(target) == {"a": "z", "b": "y"}
    assert target.run() == 3  # nothing new
    assert target.planned_rows(3).count() == 0
    assert state(target) == {"a": "z", "b": "y"}


@pytest.mark.parametrize("fails", ["plan", "apply"])
def test_replays_what_failed(spark, fails):
    """A run that dies after planning or applying is replayed as planned, without later rows."""
    root = scratch_path(spark, "log")
    first = log(spark, root)
    append(first, rows(spark, ("a", 1, "x")))
    first.plan()
    if fails == "apply":
        first.apply(1)
    again = log(spark, root)
    assert state(again) == {}
    append(again, rows(spark, ("a", 2, "y")))
    assert again.run() == 1
    assert state(again) == {"a": "x"}
    assert again.run() == 2
    assert state(again) == {"a": "y"}


def test_equal_versions_have_one_winner(spark):
    target = log(spark, scratch_path(spark, "log"))
    append(target, rows(spark, ("a", 1, "p"), ("a", 1, "q")))
    target.run()
    assert state(target) == {"a": "q"}


def test_empty(spark):
    target = log(spark, scratch_path(spark, "log"))
    append(target, rows(spark))
    target.run()
    assert state(target) == {}


def test_spans(spark):
    spans = spark.createDataFrame([(T0, T0 + timedelta(days=3)), (T0 + timedelta(days=9), None)], "s timestamp, e timestamp")
    points = spark.createDataFrame([(i, t) for i, t in enumerate([T0, T0 + timedelta(days=3), T0 + timedelta(days=3, seconds=1), T0 + timedelta(days=10), None])], "i int, t timestamp")
    assert {r["i"] for r in within_spans(points, "t", spans, "s", "e").collect()} == {0, 1}


def test_stream(spark, tmp_path):
    rows(spark, ("a", 1, "x"), ("b", 2, "y")).write.parquet(str(tmp_path / "in"))
    target = log(spark, scratch_path(spark, "log"))
    seen = []
    stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
    follow(stream, target, F.col("path"), F.col("at"), {"h": F.col("h")}, str(tmp_path / "cp"), seen.append).awaitTermination(120)
    assert seen == [1]
    assert state(target) == {"a": "x", "b": "y"}


def test_a_run_reads_only_what_was_delivered_since(spark):
    """Run N reads the folders of its own deliveries, and the sink's base replaces old batches."""
    target = ChangeLog(spark, scratch_path(spark, "log"), "k", "t", ["h"], compact_every=2)
    for i in range(5):
        append(target, rows(spark, ("a", i, f"v{i}"), (f"b{i}", i, "x")))
        assert target.run() == i + 1
        files = target.planned_rows(i + 1).inputFiles()
        assert files and all(f"/log/{i + 1}-" in f for f in files)
    assert state(target) == {"a": "v4"} | {f"b{i}": "x" for i in range(5)}
    assert target.folder.numbers("bases") == [2, 4]
    read = target.state().inputFiles()
    assert not any("/sink/4/" in f or "/sink/1/" in f for f in read) and any("/base/4/" in f for f in read)
    ends = target.ends()
    assert sum(ends.values()) == 10  # offsets go on over deliveries


def test_the_second_of_two_runners_is_refused(spark):
    root = scratch_path(spark, "log")
    one, two = log(spark, root), log(spark, root)
    append(one, rows(spark, ("a", 1, "x")))
    assert one.plan() == two.plan() == 1  # the second replays the plan of the first
    one.apply(1)
    two.apply(1)
    one.commit(1)
    with pytest.raises(Conflict):
        two.commit(1)
    assert state(two) == {"a": "x"}
    assert not one.folder.write("plans/1", "other") and one.folder.names("plans") == ["1"]


def test_a_delivery_without_its_marker_is_not_seen(spark):
    target = log(spark, scratch_path(spark, "log"))
    append(target, rows(spark, ("a", 1, "x")))
    target.folder.delete("ends/1")
    target.run()
    assert state(target) == {} and target.deliveries() == 0

"""Keyed stream tables: batches, bases, a kill between write and commit, repeats, late rows, bounded state."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronofold.streaming import stacks, upserts

DAY = datetime(2024, 1, 1)


def told(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture
def files(spark, tmp_path):
    """A folder of seven files, each with its own share of the rows; keys come back in later files, one key is null."""
    rows = [(f"k{i % 5}" if i % 11 else None, (i * 37) % 101, i) for i in range(700)]
    for part in range(7):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], "k string, v long, id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/t.parquet")
    return f"file://{tmp_path}/in", rows


def run(spark, folder, table, state):
    px = stacks.stream_table(spark, folder, "t", 1)
    return upserts.keep_up(stacks.running_stack(px, ("k",)), table, state)


def table_of(spark, folder, tmp_path, base_after=3):
    schema = stacks.running_stack(stacks.stream_table(spark, folder, "t", 1), ("k",)).schema
    return upserts.KeyedTable(spark, f"file://{tmp_path}/table", schema, ("k",), base_after)


def test_batches_end_where_one_pass_does(spark, files, tmp_path):
    folder, _ = files
    table = table_of(spark, folder, tmp_path)
    assert table.read().collect() == []
    query = run(spark, folder, table, f"file://{tmp_path}/state")
    assert len({p["batchId"] for p in map(json.loads, (x.json for x in query.recentProgress)) if p["numInputRows"]}) == 7
    assert told(table.read()) == told(stacks.running_stack(spark.read.parquet(f"{folder}/t.parquet"), ("k",)))
    assert table._folders()["base"] == {2, 5}


@pytest.mark.parametrize("killed_at", [0, 2, 4])
@pytest.mark.parametrize("when", ["before", "behind"])
def test_killed_and_resumed(spark, files, tmp_path, killed_at, when):
    """The run dies before or behind the write of a batch, but before it is committed, and goes on from its checkpoint."""
    folder, _ = files
    table = table_of(spark, folder, tmp_path)
    whole = table.upsert

    def dies(changed, batch):
        if batch == killed_at and when == "before":
            raise RuntimeError("killed")
        whole(changed, batch)
        if batch == killed_at:
            raise RuntimeError("killed")

    table.upsert = dies
    with pytest.raises(Exception, match="killed"):
        run(spark, folder, table, f"file://{tmp_path}/state")
    table.upsert = whole
    run(spark, folder, table, f"file://{tmp_path}/state")
    assert told(table.read()) == told(stacks.running_stack(spark.read.parquet(f"{folder}/t.parquet"), ("k",)))


def test_only_what_changed_is_written(spark, files, tmp_path):
    folder, _ = files
    table = table_of(spark, folder, tmp_path, 100)
    run(spark, folder, table, f"file://{tmp_path}/state")
    spark.createDataFrame([("k1", 9999, 1000)], "k string, v long, id long").coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")
    run(spark, folder, table, f"file://{tmp_path}/state")
    newest = max(table._folders()["batch"])
    assert [r["k"] for r in spark.read.parquet(f"{table.folder}/batch-{newest}").collect()] == ["k1"]
    assert table.read().where("k = 'k1'").first()["most"] == 9999


def test_a_half_written_batch_is_not_read(spark, files, tmp_path):
    folder, _ = files
    table = table_of(spark, folder, tmp_path)
    run(spark, folder, table, f"file://{tmp_path}/state")
    before = told(table.read())
    half = spark.createDataFrame([("k1", 1, 1, 1, 1, 1, 99)], "k string, most long, least long, n long, s long, q long, batch long")
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.folder}/batch-99")
    assert told(table.read()) == before


def test_repeats_late_rows_and_bounded_state(spark, tmp_path):
    """Paths repeat at once, in later files, and long after; rows behind the watermark go."""
    at = lambda hours: DAY + timedelta(hours=hours)
    files = [
        [("max", "a", at(0)), ("max", "a", at(0)), ("min", "a", at(1)), (None, "n", at(1)), (None, "n", at(1))],
        [("max", "a", at(2)), ("max", "b", at(3))],
        [("max", "c", at(30)), ("max", "b", at(31))],  # b is forgotten by now or not, c moves the watermark on
        [("max", "late", at(1)), ("max", "d", at(60))],
        [("max", "a", at(61)), ("max", "d", at(62))],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "category string, path string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/t.parquet")
        new = upserts.first_of_each(stacks.stream_table(spark, f"file://{tmp_path}/in", "t", 1), ("category", "path"), "ts", "10 hours")
        query = upserts.append_new(new, f"file://{tmp_path}/new", f"file://{tmp_path}/state")
    found = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/new").select("category", "path").collect()]
    assert found.count(("max", "a")) == 2  # hours 0 and 61: long after, it is new again
    assert found.count(("min", "a")) == found.count((None, "n")) == found.count(("max", "c")) == found.count(("max", "d")) == 1
    assert found.count(("max", "late")) == 0
    state = query.lastProgress.stateOperators[0].numRowsTotal
    assert state <= 3  # of nine keys, those of the last ten hours and of the last batch
    assert spark.read.parquet(f"{tmp_path}/new").where(F.col("path") == "late").count() == 0

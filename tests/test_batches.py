"""Named batches: rows once or not at all, whatever tasks and jobs do."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.sources import batches, sinks


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    batches.register(spark)


def put(rows, folder, mode="append", **options):
    rows.write.format("batches").options(**options).mode(mode).save(str(folder))


def ids(spark, folder):
    return sorted(r.id for r in batches.read(spark, str(folder)).collect())


def test_batches_count_once(spark, tmp_path):
    rows = spark.range(100, numPartitions=3).withColumns({"t": F.concat(F.lit("é"), "id"), "w": F.array("id"), "n": F.lit(None).cast("double")})
    for _ in range(2):
        put(rows, tmp_path / "a", batch="one", fileRows=10)
    put(rows.where("id < 5"), f"file://{tmp_path}/a", batch="two")
    found = batches.read(spark, str(tmp_path / "a"))
    assert found.dtypes == rows.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect() + rows.where("id < 5").collect()))
    told = batches.notes(str(tmp_path / "a"))
    assert {k: v["rows"] for k, v in told.items()} == {"one": 100, "two": 5} and len(told["one"]["files"]) == 12
    assert batches.sweep(str(tmp_path / "a")) == 0


def test_overwrite_and_sweep(spark, tmp_path):
    for k in range(2):
        put(spark.range(k, k + 3), tmp_path / "b")
    put(spark.range(7), tmp_path / "b", "overwrite", batch="new")
    assert ids(spark, tmp_path / "b") == list(range(7)) and list(batches.notes(str(tmp_path / "b"))) == ["new"]
    assert batches.sweep(str(tmp_path / "b")) > 0 and ids(spark, tmp_path / "b") == list(range(7))


def test_failed_job_leaves_nothing(spark, tmp_path):
    put(spark.range(5), tmp_path / "c", batch="good")
    broken = spark.range(40, numPartitions=4).withColumn("t", F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise("x"))
    with pytest.raises(Exception, match="stop"):
        put(broken, tmp_path / "c", batch="bad")
    assert ids(spark, tmp_path / "c") == list(range(5)) and list(batches.notes(str(tmp_path / "c"))) == ["good"]


def test_task_that_runs_twice(spark, tmp_path):
    """An attempt that dies after its rows are written leaves a file that no note names."""
    writer = batches.BatchWriter({"path": str(tmp_path / "d"), "batch": "x"}, spark.range(1).schema, False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 3], pa.int64())})

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    before = batches.TaskContext.get
    try:
        batches.TaskContext.get = staticmethod(lambda: Task(0))
        lost = writer.write(iter([batch]))
        batches.TaskContext.get = staticmethod(lambda: Task(1))
        kept = writer.write(iter([batch]))

        def dying():
            yield batch
            raise RuntimeError("killed")

        with pytest.raises(RuntimeError):
            writer.write(dying())
    finally:
        batches.TaskContext.get = before
    writer.commit([kept, None])
    assert ids(spark, tmp_path / "d") == [1, 2, 3]
    assert len(list((tmp_path / "d" / "rows").iterdir())) == 2 and lost.files != kept.files
    assert batches.sweep(str(tmp_path / "d")) == 1
    late = batches.BatchWriter({"path": str(tmp_path / "d"), "batch": "x"}, spark.range(1).schema, False)
    assert late.there and late.write(iter([batch])).files == []


def test_lines_and_empty(spark, tmp_path):
    rows = spark.range(4).select(F.to_json(F.struct("id", F.lit("a\nb").alias("t"))).alias("json"))
    put(rows, tmp_path / "e", lines=True, batch="one")
    assert sorted(r.value for r in batches.read(spark, str(tmp_path / "e")).collect()) == sorted(r.json for r in rows.collect())
    with pytest.raises(Exception, match="single column"):
        put(spark.range(3), tmp_path / "f", lines=True)
    put(spark.range(0), tmp_path / "g", batch="none")
    assert batches.read(spark, str(tmp_path / "g")).columns == ["id"] and ids(spark, tmp_path / "g") == []
    with pytest.raises(ValueError, match="no batch"):
        batches.read(spark, str(tmp_path / "h"))
    with pytest.raises(Exception, match="not a name"):
        put(spark.range(3), tmp_path / "g", batch="a/b")


def test_columns_that_come_later(spark, tmp_path):
    put(spark.range(1), tmp_path / "i", batch="a")
    put(spark.range(1, 2).withColumn("t", F.lit("x")), tmp_path / "i", batch="b")
    assert sorted(map(tuple, batches.read(spark, str(tmp_path / "i")).collect())) == [(0, None), (1, "x")]
    put(spark.range(1).select(F.lit("x").alias("id")), tmp_path / "i", batch="c")
    with pytest.raises(ValueError, match="two types"):
        batches.read(spark, str(tmp_path / "i"))


def test_stream(spark, tmp_path):
    """A stream that begins again with the notes of its batches there adds none of them twice."""
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.parquet(str(tmp_path / "in" / str(k)))
    for check in ("one", "one", "two"):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in" / "*"))
        stream.writeStream.format("batches").option("name", "s").option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert ids(spark, tmp_path / "out") == list(range(30))
    assert batches.sweep(str(tmp_path / "out")) == 0


def test_totals_in_one_job(spark, tmp_path):
    """Totals come with the job that writes; a batch that is there runs no job."""
    answers = spark.range(1000, numPartitions=4).select("id", F.when(F.col("id") % 10 == 0, "boom").when(F.col("id") % 10 == 1, "").alias("error"), (F.col("id") % 7 / 4).alias("inference_time_ms"))
    expected = {"n_rows": 1000, "n_errors": 100, "total_ms": sum(round(k % 7 / 4 * 100) for k in range(1000)) / 100}
    spark.sparkContext.setJobGroup("storing", "")
    assert sinks.store_answers(answers, str(tmp_path / "t"), "a") == expected
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("storing"))
    assert sinks.store_answers(answers.limit(1), str(tmp_path / "t"), "a") == expected
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("storing")) == 1
    assert batches.read(spark, str(tmp_path / "t")).count() == 1000
    assert sinks.store_answers(answers.where("false"), str(tmp_path / "t"), "b") == {"n_rows": 0, "n_errors": 0, "total_ms": 0}
    note = tmp_path / "t" / "_batches" / "a.json"
    note.write_text(json.dumps({k: v for k, v in json.loads(note.read_text()).items() if k != "totals"}))
    assert sinks.store_answers(answers, str(tmp_path / "t"), "a") == expected == json.loads(note.read_text())["totals"]

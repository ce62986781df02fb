"""The sink of single files: all or none, old files until the commit, and a job that died after it is finished later."""

import os

import pytest
from pyspark.sql import functions as F

from markwise.sources import files


def table(spark, n, content):
    return spark.range(n).select(F.format_string("f%03d", "id").alias("image_id"), F.lit(content).cast("binary").alias("content")).repartition(3)


def there(folder):
    return {p: open(os.path.join(folder, p), "rb").read() for p in os.listdir(folder) if not p.startswith("_")} if os.path.isdir(folder) else {}


def staged(folder):
    return [p for d, _, names in os.walk(os.path.join(folder, files.STAGING)) for p in names]


def test_files_are_written_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.export(table(spark, 20, "one"), folder, ".txt")
    assert there(folder) == {f"f{i:03}.txt": b"one" for i in range(20)} and not staged(folder)
    files.export(table(spark, 5, "two"), f"file://{folder}", ".txt")
    assert there(folder) == {f"f{i:03}.txt": b"two" if i < 5 else b"one" for i in range(20)}
    files.export(table(spark, 0, ""), folder)
    assert len(there(folder)) == 20
    assert spark.read.format("binaryFile").load(folder).count() == 20  # what is staged is hidden


def test_a_failing_task_leaves_the_old_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.export(table(spark, 6, "one"), folder)
    bad = table(spark, 6, "two").withColumn("image_id", F.when(F.col("image_id") == "f003", "a/b").otherwise(F.col("image_id")))
    with pytest.raises(Exception, match="no file name"):
        files.export(bad, folder)
    assert set(there(folder).values()) == {b"one"} and not staged(folder)


def test_a_job_that_dies_between_commit_and_publish(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.export(table(spark, 6, "old"), folder)
    spark.dataSource.register(files.FileSink)
    writer = files.FileWriter(folder, ".png", "job1")
    import pyarrow as pa

    names = [f"f{i:03}" for i in range(9)]
    done = writer.write(iter([pa.record_batch([pa.array(names), pa.array([b"new"] * 9)], names=["image_id", "content"])]))
    assert set(there(folder).values()) == {b"old"}  # nothing is in place before the commit
    store, path = files.opened(folder)
    calls, real = [], files.publish

    def die(*a):
        calls.append(a)
        raise KeyboardInterrupt

    files.publish = die
    try:
        with pytest.raises(KeyboardInterrupt):
            writer.commit([done, None])
    finally:
        files.publish = real
    assert calls and len(there(folder)) == 6  # the old files are there
    os.replace(*done.files[0])  # it had moved some
    assert files.recover(folder) == 1 and there(folder) == {f"{n}.png": b"new" for n in names} and not staged(folder)
    assert files.recover(folder) == 0 and files.recover(str(tmp_path / "none")) == 0


def test_a_job_that_dies_before_the_commit_is_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.export(table(spark, 2, "old"), folder)
    import pyarrow as pa

    files.FileWriter(folder, ".png", "lost").write(iter([pa.record_batch([pa.array(["f000"]), pa.array([b"new"])], names=["image_id", "content"])]))
    assert files.recover(folder) == 0 and set(there(folder).values()) == {b"old"}
    with pytest.raises(Exception, match="append"):
        table(spark, 1, "x").write.format(files.FORMAT).mode("overwrite").save(folder)
    with pytest.raises(Exception, match="content"):
        table(spark, 1, "x").drop("content").write.format(files.FORMAT).mode("append").save(folder)

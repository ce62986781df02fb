"""The stream of progress: after every micro-batch the steps of the table, also after a restart; late rows; stuck images."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from markwise.operators import progress
from markwise.streaming import steps

START = dt.datetime(2024, 1, 1)


def batch(spark, folder, rows):
    spark.createDataFrame(rows, steps.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def of_table(spark, seen):
    rows = spark.createDataFrame(seen, steps.EVENTS)
    images = rows.where("kind = 'raw'").select("image_id")
    found = progress.progress(images, rows.where("kind not in ('raw', 'metrics')").select("image_id", "kind"), rows.where("kind = 'metrics'").select("image_id", F.col("value").alias("pixels_per_mm")))
    return {tuple(r) for r in progress.required_steps(found).collect()}


def run(spark, folder, target, checkpoint, **options):
    events = spark.readStream.schema(steps.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    query = steps.keep_steps(events, target, checkpoint, **options)
    assert query.awaitTermination(120)


def test_steps_after_every_batch_and_restart(spark, tmp_path):
    r = random.Random(4)
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [(f"i{k}", kind, float(r.choice([0, 3])) if kind == "metrics" else None) for k in range(12) for kind in steps.KINDS if kind == "raw" and k != 5 or kind != "raw" and r.random() < 0.6]
    rows += [("i1", "unknown", None), (None, "raw", None), ("i2", "raw", None)]
    r.shuffle(rows)
    seen = []
    for n in range(3):  # each run is a restart from the checkpoint, and its rows are a day older than the ones before
        new = [(*x, START - dt.timedelta(days=n)) for x in rows[n::3]]
        batch(spark, folder, new)
        seen += [x for x in new if x[0] is not None]
        run(spark, folder, target, checkpoint)
        got = {tuple(x) for x in steps.steps_now(spark, target).drop("stuck").collect()}
        assert got == of_table(spark, seen)


def test_stuck_images(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    whole = [("done", k, 2.0, START) for k in ("raw", "fish", "ruler", "metrics", "image", "mask")]
    options = {"late": "1 minute", "patience_ms": 600_000}
    stuck = lambda: {r.image_id: r.stuck for r in steps.steps_now(spark, target).collect()}
    batch(spark, folder, [("slow", "raw", None, START), *whole])
    run(spark, folder, target, checkpoint, **options)
    assert stuck() == {"slow": False, "done": False}
    for hours in (2, 3):  # the watermark passes
        batch(spark, folder, [("other", "raw", None, START + dt.timedelta(hours=hours))])
        run(spark, folder, target, checkpoint, **options)
    assert stuck()["slow"] is True and stuck()["done"] is False
    batch(spark, folder, [("slow", "fish", None, START + dt.timedelta(hours=4))])
    run(spark, folder, target, checkpoint, **options)
    assert stuck()["slow"] is False


def test_new_and_done_images_ask_little_of_the_state():
    """Each call to the state store is a message: a new image asks for its flags once, and for no timers; one that is done gets none."""

    class Store:
        def __init__(self):
            self.calls, self.value, self.timers = [], None, []

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def listTimers(self):  # noqa: N802
            self.calls.append("list")
            return list(self.timers)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

        def registerTimer(self, at):  # noqa: N802
            self.calls.append("register")
            self.timers.append(at)

    store, images = Store(), steps.Steps(1000)
    images.init(store)
    give = lambda *kinds: list(images.handleInputRows(("a",), iter([pd.DataFrame([(k, 2.0, pd.Timestamp(START)) for k in kinds], columns=["kind", "value", "ts"])]), None))
    assert len(give("raw", "fish")) == 1 and store.calls == ["get", "update", "register"]
    assert len(give("ruler", "metrics", "image", "mask")) == 1 and store.timers == []

"""Maintenance operators over whole tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline import registry
from quarryline.operators import maintenance as MT


@pytest.mark.parametrize("most", [0, 1, 40, 250, 700, 900])
def test_prunable_tasks_against_brute_force(spark, most):
    r = random.Random(most)
    rows = [(i, r.choice(["running", "completed", "failed"]), r.choice(["", "shutdown", None]), r.choice([None, 0, 59, 60, 61, 3600, 3601, 86400 * 3, 86400 * 20])) for i in range(800)]
    rows += [(800 + i, "completed", "", 7200) for i in range(80)]  # many in one minute
    tasks = spark.createDataFrame(rows, "id long, state string, error string, at long").select("id", "state", "error", F.timestamp_seconds("at").alias("submitted_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    got = [x["id"] for x in MT.prunable_tasks(tasks, most, "1970-01-20 00:00:00").collect()]
    ok = [(-1 if at is None else at, i) for i, s, e, at in rows if s != "running" and (e != "shutdown" or (at is not None and at < 86400 * 12))]
    assert sorted(got) == sorted(i for _, i in sorted(ok)[: max(0, len(rows) - most)])


def test_prunable_tasks_sort_no_whole_table_in_one_task(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(Window, "orderBy", lambda *c, f=Window.orderBy: seen.append(c) or f(*c))
    registry.queries()["t8_prunable"](spark, sf)
    assert seen == [("_b",)]  # one row per minute


@pytest.mark.parametrize("name", ["t8_prunable", "j12_i10_unreferenced"])
def test_all_events_take_part(spark, sf, name):
    ids = {int(str(x["id"]).removeprefix("seg")) for x in registry.queries()[name](spark, sf).collect()}
    assert max(ids) >= 500 and any(i % 100 for i in ids)

"""Watching workspaces and provider calls as streams."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reliability import AUTH_S, BASE_S, MOST_S, RATE_S


class Backoff:
    """Waits of a root that fails to sync: doubling from least to most, from the start after a success."""

    def __init__(self, least: float = 5.0, most: float = 120.0):
        self.least, self.most, self.wait, self.until = least, max(least, most), 0.0, 0.0

    def failed(self, now: float) -> float:
        self.wait = self.least if self.wait <= 0 else min(self.most, self.wait * 2)
        self.until = now + self.wait
        return self.wait

    def succeeded(self) -> None:
        self.wait = self.until = 0.0


def watch(spark: SparkSession, roots: list[str], changed: Callable[[str], bool], sync: Callable[[str], object], poll: str = "30 seconds", debounce: float = 2.0, most: int = 64):
    """A streaming query that polls the roots on a processing-time trigger: a changed root is synced once it
    has been quiet for `debounce` seconds, a failing one waits. Stop it with .stop()."""
    if len(roots) > most:
        raise ValueError(f"at most {most} roots are watched")
    waits = {r: Backoff() for r in roots}
    dirty: dict[str, float] = {}

    def tick(_: DataFrame, __: int) -> None:
        for r in roots:
            now = time.time()
            if now < waits[r].until:
                continue
            try:
                if r not in dirty and changed(r):
                    dirty[r] = now
                if r in dirty and now - dirty[r] >= debounce:
                    sync(r)
                    del dirty[r]
                waits[r].succeeded()
            except Exception:
                waits[r].failed(time.time())

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=poll).foreachBatch(tick).start()


def circuits(calls: DataFrame) -> DataFrame:
    """(key, ts, state, failures, wait_s) after every micro-batch of calls (key, ts, failed, kind, retry_after).

    Each key's state is its failures in a row and the time it is closed until."""

    def step(key, pdfs, state: GroupState):
        failures, until = state.get if state.exists else (0, 0.0)
        last = 0.0
        for pdf in pdfs:
            for r in pdf.sort_values("ts").itertuples():
                last = r.ts.timestamp()
                if not r.failed:
                    failures, until = 0, 0.0
                    continue
                failures += 1
                if r.kind in ("auth", "quota"):
                    wait = AUTH_S
                elif r.kind == "rate_limit":
                    wait = min(r.retry_after if r.retry_after > 0 else RATE_S, MOST_S)
                else:
                    wait = min(BASE_S * 2 ** min(failures - 1, 4), MOST_S)
                until = last + wait
        state.update((int(failures), float(until)))
        name = "healthy" if failures == 0 else "backoff" if last < until else "candidate"
        yield pd.DataFrame({"key": [key[0]], "ts": [pd.Timestamp(last, unit="s")], "state": [name], "failures": [failures], "wait_s": [max(0.0, until - last)]})

    kind = dict(calls.dtypes)["key"]
    return calls.groupBy("key").applyInPandasWithState(step, f"key {kind}, ts timestamp, state string, failures long, wait_s double", "failures long, until double", "update", GroupStateTimeout.NoTimeout)


def minute_usage(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests and tokens per key and fixed minute of a stream (key, ts, tokens), final once the minute is
    `late` behind the newest request."""
    g = requests.withWatermark("ts", late).groupBy("key", F.window("ts", "1 minute").alias("w"))
    return g.agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens")).select("key", F.col("w.start").alias("minute"), "requests", "tokens")

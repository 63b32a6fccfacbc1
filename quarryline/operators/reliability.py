"""Provider health over event tables: circuits, budgets and the rate governor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTH_S, RATE_S, BASE_S, MOST_S = 900, 30, 30, 300


def backoff_seconds(failures: Column, least: int = 5, most: int = 120) -> Column:
    """Watch backoff after so many failures in a row."""
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(most), least * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(30)))).cast("long"))


def failure_streaks(events: DataFrame, key: str = "key", ts: str = "ts", order: str = "event_id", failed: str = "failed") -> DataFrame:
    """Events with `streak`, the failures in a row up to and with each."""
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    island = events.withColumn("_i", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w))
    v = Window.partitionBy(key, "_i").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(F.col(failed).cast("int")).over(v)).drop("_i")


def circuit_wait(kind: Column, streak: Column, retry_after: Column) -> Column:
    """Seconds a circuit stays open after a failure of this kind, the streak-th in a row."""
    doubling = F.least(F.lit(MOST_S), BASE_S * F.pow(F.lit(2.0), F.least(streak - 1, F.lit(4)))).cast("long")
    rate = F.least(F.when(F.coalesce(retry_after, F.lit(0)) > 0, retry_after).otherwise(RATE_S), F.lit(MOST_S)).cast("long")
    return F.when(kind.isin("auth", "quota"), AUTH_S).when(kind == "rate_limit", rate).otherwise(doubling)


def circuit_state(events: DataFrame, at: Column) -> DataFrame:
    """(key, failures, wait_s, state) after each key's last event: healthy, backoff or candidate at a time."""
    s = failure_streaks(events)
    last = s.groupBy("key").agg(F.max_by(F.struct("streak", "ts", "kind", "retry_after"), F.struct("ts", "event_id")).alias("l")).select("key", "l.*")
    wait = F.when(F.col("streak") > 0, circuit_wait(F.col("kind"), F.col("streak"), F.col("retry_after"))).otherwise(0)
    state = F.when(F.col("streak") == 0, "healthy").when(F.unix_timestamp(at) < F.unix_timestamp("ts") + F.col("wait_s"), "backoff").otherwise("candidate")
    return last.withColumn("wait_s", wait.cast("long")).select("key", F.col("streak").alias("failures"), "wait_s", state.alias("state"))


def minute_budget(requests: DataFrame, rpm: int, tpm: int) -> DataFrame:
    """(key, minute, requests, tokens, over): use per fixed minute; a single request never counts as over."""
    minute = F.date_trunc("minute", F.col("ts"))
    g = requests.groupBy("key", minute.alias("minute")).agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
    return g.withColumn("over", (F.col("requests") > 1) & (((F.col("requests") > rpm) if rpm > 0 else F.lit(False)) | ((F.col("tokens") > tpm) if tpm > 0 else F.lit(False))))


def ewma(samples: Column, alpha: float) -> Column:
    """Exponential mean of an array, the first sample as it is."""
    rest = F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0)))
    return F.when(F.size(samples) > 0, F.aggregate(rest, samples[0], lambda a, x: a + F.lit(alpha) * (x - a)))


FLOOR_TOKENS, CUT, GROW = 40_000.0, 0.5, 0.02
SHORT, LONG, DIVERGENCE, GROW_EVERY, MIN_SAMPLES = 0.2, 0.02, 1.5, 8, 16


class Governor:
    """Rate and window control, fed one outcome at a time: success(latency, tokens), rate_limited or overload.

    The first 429 turns rate control on at half the recent throughput; each further one halves the rate, a
    success adds two percent, never under the floor. The window of requests halves on overload and where the
    short latency mean runs away from the long one, and grows by one after eight calm samples."""

    def __init__(self, window: int = 8, most: int = 16, rate: float | None = None):
        self.window, self.most, self.rate = window, most, rate
        self.recent = self.short = self.long = 0.0
        self.samples = self.calm = 0
        self.began: float | None = None

    def observe(self, outcome: str, at: float, tokens: int = 0, latency: float = 0.0) -> None:
        if outcome == "success":
            if self.began is None or at - self.began > 60:
                self.began, self.recent = at, 0.0
            self.recent += tokens
            if self.rate is not None:
                self.rate *= 1 + GROW
            if latency > 0:
                self._latency(latency)
        elif outcome == "rate_limited":
            if self.rate is None:
                span = at - self.began if self.began is not None else 0.0
                seen = self.recent / (span / 60) if 1 < span < 60 else self.recent
                self.rate = max(seen * CUT, FLOOR_TOKENS)
            else:
                self.rate = max(self.rate * CUT, FLOOR_TOKENS)
        elif outcome == "overload":
            self._shrink()

    def _latency(self, x: float) -> None:
        self.samples += 1
        if self.samples == 1:
            self.short = self.long = x
        else:
            self.short += SHORT * (x - self.short)
            self.long += LONG * (x - self.long)
        if self.samples < MIN_SAMPLES:
            return
        if self.short > self.long * DIVERGENCE:
            self._shrink()
            self.short = self.long
            return
        self.calm += 1
        if self.calm >= GROW_EVERY and self.window < self.most:
            self.window += 1
            self.calm = 0

    def _shrink(self) -> None:
        self.calm = 0
        self.window = max(1, self.window // 2)


def governor_trace(events: DataFrame) -> DataFrame:
    """(key, window, rate, samples) after each key's events (key, ts, event_id, outcome, tokens, latency).

    The control is a fold in event order, key by key; the state carried is constant and batches stream."""

    def fold(pdf):
        import pandas as pd

        g = Governor()
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            g.observe(r.outcome, r.ts.timestamp(), r.tokens, r.latency)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "window": [g.window], "rate": [g.rate if g.rate is not None else 0.0], "samples": [g.samples]})

    kind = dict(events.dtypes)["key"]
    return events.groupBy("key").applyInPandas(fold, f"key {kind}, window long, rate double, samples long")

"""Breaker and token bucket as streams with typed state and event-time timers (transformWithState).

Attempts may arrive in any order within the watermark's lateness: a strategy's attempts wait as packed chunks of an hour each until the
watermark has passed them, a timer at the first one's time, and are then folded hour by hour in the order of their times. A timer also stands
where an open breaker lets an attempt through again, so that this is told without an attempt. The state of a strategy is two numbers and the
chunks that wait; a task holds one hour of one strategy, or BUFFER arriving rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from papyrus.operators.attempts import DEFAULT_RATE, RATES
from papyrus.streaming import events as S

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: event_id is null where a timer, not an attempt, tells of a state.
OUT = "event_id long, strategy string, t double, state string"
#: Attempts that wait: microseconds of a chunk, arriving rows that are packed together, and a row's form.
SPAN, BUFFER = 3_600_000_000, 200_000
ROW = np.dtype([("micros", "<i8"), ("event_id", "<i8"), ("success", "u1")])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of OUT; as plain objects, since ids may be null and Arrow takes no chunked strings here."""
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype="float64" if name == "t" else object) for k, name in enumerate(("event_id", "strategy", "t", "state"))})


class Fold(StatefulProcessor):
    """Keeps attempts until the watermark has passed them and folds them in order. The memory (two doubles) starts as ``start`` gives it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "a double, b double")
        # A chunk's key: its first time and a number of its own.
        self.waiting = handle.getMapState("waiting", "least long, chunk long", "rows binary")
        self.chunks = handle.getValueState("chunks", "n long")

    def start(self, strategy: str, t: float) -> tuple[float, float]:
        raise NotImplementedError

    def step(self, strategy: str, memory: tuple[float, float], t: float, success: bool) -> tuple[tuple[float, float], str]:
        """The memory after an attempt, and the state that it is told."""
        raise NotImplementedError

    def due(self, memory: tuple[float, float]) -> tuple[float, str] | None:
        """When memory alone changes the state next, and to which one."""
        return None

    def after_due(self, memory: tuple[float, float]) -> tuple[float, float]:
        return memory

    def _keep(self, rows: np.ndarray) -> None:
        """rows (ROW, in the order of their arrival) as a chunk for each hour, and a timer at the first time."""
        if not len(rows):
            return
        span = rows["micros"] // SPAN
        order = np.argsort(span, kind="stable")
        n = self.chunks.get()[0] if self.chunks.exists() else 0
        for part in np.split(rows[order], np.flatnonzero(np.diff(span[order])) + 1):
            self.waiting.updateValue((int(part["micros"].min()), n), (part.tobytes(),))
            n += 1
        self.chunks.update((n,))
        self.handle.registerTimer(int(rows["micros"].min()) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        buffer, held = [], 0
        for batch in rows:
            packed = np.empty(len(batch), ROW)
            for name in ROW.names:
                packed[name] = batch[name].to_numpy()
            buffer.append(packed)
            held += len(packed)
            if held >= BUFFER:
                self._keep(np.concatenate(buffer))
                buffer, held = [], 0
        if buffer:
            self._keep(np.concatenate(buffer))
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        memory, out = self.memory.get() if self.memory.exists() else None, []
        memory = tuple(memory) if memory is not None else None

        def tell(until: float) -> None:
            nonlocal memory
            change = self.due(memory) if memory is not None else None
            if change and change[0] <= until:
                out.append((None, key[0], change[0], change[1]))
                memory = self.after_due(memory)

        spans, later = {}, None
        for least, chunk in sorted(self.waiting.keys()):
            if least // 1000 * 1000 <= now:
                spans.setdefault(least // SPAN, []).append((chunk, least))
            elif later is None:
                later = least
        for span in sorted(spans):
            chunks = sorted(spans[span])  # as they came
            rows = np.concatenate([np.frombuffer(self.waiting.getValue((least, chunk))[0], ROW) for chunk, least in chunks])
            for chunk, least in chunks:
                self.waiting.removeKey((least, chunk))
            past = rows["micros"] // 1000 * 1000 <= now
            self._keep(rows[~past])
            rows = rows[past]
            rows = rows[np.lexsort((rows["event_id"], rows["micros"]))]
            last = np.append((rows["micros"][1:] != rows["micros"][:-1]) | (rows["event_id"][1:] != rows["event_id"][:-1]), True)  # of a repeated attempt the one that came last
            for micros, event, ok in rows[last].tolist():
                t = micros / 1e6
                memory = self.start(key[0], t) if memory is None else memory
                tell(t)
                memory, state = self.step(key[0], memory, t, bool(ok))
                out.append((event, key[0], t, state))
            yield _frame(out)
            out.clear()
        tell(now / 1e6)
        if memory is not None:
            self.memory.update(memory)
            change = self.due(memory)
            if change:
                self.handle.registerTimer(int(change[0] * 1000) + 1)
        if later is not None:
            self.handle.registerTimer(later // 1000)
        yield _frame(out)

    def close(self) -> None:
        pass


class Breaker(Fold):
    """Memory: failures in a row (negative once it was told that an attempt is let through), and since when it is open (or -1)."""

    def __init__(self, threshold: int, timeout_s: float) -> None:
        self.threshold, self.timeout_s = threshold, timeout_s

    def start(self, strategy: str, t: float) -> tuple[float, float]:
        return 0.0, -1.0

    def step(self, strategy: str, memory: tuple[float, float], t: float, success: bool) -> tuple[tuple[float, float], str]:
        failures, opened = abs(memory[0]), memory[1]
        state = "closed" if opened < 0 else "open" if t - opened < self.timeout_s else "half-open"
        if state == "open":
            return memory, state
        failures = 0.0 if success else failures + 1
        return (failures, -1.0 if success else t if failures >= self.threshold else opened), state

    def due(self, memory: tuple[float, float]) -> tuple[float, str] | None:
        return (memory[1] + self.timeout_s, "half-open") if memory[1] >= 0 and memory[0] > 0 else None

    def after_due(self, memory: tuple[float, float]) -> tuple[float, float]:
        return -memory[0], memory[1]


class Bucket(Fold):
    """Memory: tokens and the time of the last attempt."""

    def __init__(self, rates: dict[str, tuple[float, float]], default: tuple[float, float]) -> None:
        self.rates, self.default = rates, default

    def start(self, strategy: str, t: float) -> tuple[float, float]:
        return self.rates.get(strategy, self.default)[1], t

    def step(self, strategy: str, memory: tuple[float, float], t: float, success: bool) -> tuple[tuple[float, float], str]:
        rate, capacity = self.rates.get(strategy, self.default)
        tokens = min(capacity, memory[0] + (t - memory[1]) * rate)
        granted = tokens >= 1
        return (tokens - granted, t), "granted" if granted else "refused"


def attempts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of attempts: event_id, strategy, ts, success; with the row that ends it (a null strategy)."""
    return S.source(spark, sf_dir).select("event_id", F.col("event_type").alias("strategy"), "ts", (F.col("value") >= 10).alias("success"))


def folded(attempts: DataFrame, fold: Fold, late: str) -> DataFrame:
    """attempts (event_id, strategy, ts, success), a stream -> OUT. Attempts later than ``late`` are lost; others may come in any order."""
    kept = F.col("strategy").isNotNull() | F.col("ts").isNull()  # of ts too, so that the filter stays behind the watermark
    own = attempts.withWatermark("ts", late).where(kept).withColumn("micros", F.unix_micros("ts"))
    return own.groupBy("strategy").transformWithStateInPandas(statefulProcessor=fold, outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run(stream: DataFrame) -> DataFrame:
    """S.run() with the state store that timers need."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return S.run(stream)
    finally:
        spark.conf.set(STORE, before)


def breaker(attempts: DataFrame, threshold: int = 3, timeout_s: float = 300.0, late: str = "1 hour") -> DataFrame:
    """The breaker's state before each attempt, as operators.attempts.breaker_states() has it, and a row without event_id where an open breaker starts to let an attempt through."""
    return folded(attempts, Breaker(threshold, timeout_s), late)


def bucket(attempts: DataFrame, rates: dict[str, tuple[float, float]] = RATES, default: tuple[float, float] = DEFAULT_RATE, late: str = "1 hour") -> DataFrame:
    """Whether each attempt got a token, as operators.attempts.token_bucket() has it."""
    return folded(attempts, Bucket(rates, default), late)

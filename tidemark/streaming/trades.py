"""Streaming trade flow: sources, tumbling bars, flushes, de-duplication, stateful strategies.

Bars use event time and a watermark. Every trade counts, the first of a minute included; trades later
than the watermark are dropped by the engine and show up in the query's ``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed values: the aggregated-trade message (epoch milliseconds, quantity as text, seller flag)
MESSAGE = "T BIGINT, q STRING, m BOOLEAN, s STRING, p STRING"


def read_trade_files(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """JSON-lines message files as a stream."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)
    return parse_messages(lines)


def read_trade_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same messages from a Kafka topic (needs the Kafka package on the cluster)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_messages(raw.select(F.col("value").cast("string").alias("value")))


def parse_messages(lines: DataFrame) -> DataFrame:
    m = lines.select(F.from_json("value", MESSAGE).alias("m")).where("m.T IS NOT NULL")
    return m.select(
        F.col("m.s").alias("symbol"), F.timestamp_millis("m.T").alias("trade_time"), F.col("m.q").try_cast("double").alias("quantity"),
        F.col("m.p").try_cast("double").alias("price"), F.coalesce("m.m", F.lit(False)).alias("is_buyer_maker"),
    )


def _flow() -> list:
    sell = F.col("is_buyer_maker")
    return [
        F.sum(F.when(~sell, F.col("quantity")).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(sell, F.col("quantity")).otherwise(0.0)).alias("sell_volume"),
        F.count(F.lit(1)).alias("trades"),
    ]


def _flat(df: DataFrame) -> DataFrame:
    return df.select("symbol", F.col("_w.start").alias("ts"), "buy_volume", "sell_volume", "trades", (F.col("buy_volume") - F.col("sell_volume")).alias("delta"))


def minute_flow(trades: DataFrame, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Buy, sell and net volume per tumbling window; append mode emits closed windows."""
    return _flat(trades.withWatermark("trade_time", late).groupBy(F.window("trade_time", width).alias("_w"), "symbol").agg(*_flow()))


def sliding_flow(trades: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    return _flat(trades.withWatermark("trade_time", late).groupBy(F.window("trade_time", width, slide).alias("_w"), "symbol").agg(*_flow()))


def session_flow(trades: DataFrame, gap: str = "5 minutes", late: str = "2 minutes") -> DataFrame:
    return _flat(trades.withWatermark("trade_time", late).groupBy(F.session_window("trade_time", gap).alias("_w"), "symbol").agg(*_flow()))


def without_repeats(trades: DataFrame, keys=("symbol", "trade_id"), late: str = "10 minutes") -> DataFrame:
    """One row per key within the watermark."""
    return trades.withWatermark("trade_time", late).dropDuplicatesWithinWatermark(list(keys))


def flush(bars: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hand each micro-batch, sorted, to ``sink``: every so often, or (tests, back-fills) until the input is used up."""
    writer = bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda df, epoch: sink(df.orderBy("symbol", "ts"), epoch)).start()


# --- stateful operators ----------------------------------------------------------------------

BAR_STATE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("close", T.DoubleType())])


def _ordered(rows: Iterator[pd.DataFrame], column: str) -> pd.DataFrame:
    frames = list(rows)
    return pd.concat(frames).sort_values(column, kind="mergesort") if frames else pd.DataFrame(columns=[column])


class TrailingSignal(StatefulProcessor):
    """Per key: keep the last ``size`` closes and emit a rule's value for each new bar once warm."""

    def __init__(self, rule: Callable[[list[float]], float], size: int = 200, warm: int = 1):
        self.rule, self.size, self.warm = rule, size, warm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", BAR_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        kept = [(t, c) for t, c in self.bars.get()] if self.bars.exists() else []
        new = _ordered(rows, "ts")
        out = []
        for ts, close in zip(new["ts"], new["close"]):
            kept = [*kept, (ts.to_pydatetime(), float(close))][-self.size :]
            if len(kept) >= self.warm:
                out.append((key[0], ts, float(close), float(self.rule([c for _, c in kept]))))
        self.bars.put(kept)
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "signal"])

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timers: Any) -> None:
        warm = initial.sort_values("ts")
        self.bars.put([(t.to_pydatetime(), float(c)) for t, c in zip(warm["ts"], warm["close"])][-self.size :])

    def close(self) -> None:
        pass


def trailing_signal(bars: DataFrame, rule: Callable[[list[float]], float], size: int = 200, warm: int = 1, history: DataFrame | None = None) -> DataFrame:
    """Signal per new bar from the trailing closes; ``history`` (symbol, ts, close) warms the state up."""
    return bars.select("symbol", "ts", "close").groupBy("symbol").transformWithStateInPandas(
        TrailingSignal(rule, size, warm), "symbol string, ts timestamp, close double, signal double", "append", "None",
        initialState=history.groupBy("symbol") if history is not None else None,
    )


#: waiting rows of one hour: times in microseconds, values and sides as the bytes of their arrays
HOUR_STATE = T.StructType([T.StructField(c, T.BinaryType()) for c in ("us", "value", "is_side")])
_HOUR = 3_600_000_000
#: rows that lie in memory before they go to the state
_ROWS_AT_ONCE = 200_000


class LastKnown(StatefulProcessor):
    """Per key: price rows wait until the watermark has passed them, so side rows that arrive later but happened earlier count.

    Waiting rows are kept in the state by hour, in pieces as they arrive; on equal times side rows come first. A key is settled hour by
    hour, so memory holds the rows of one hour or one piece, whatever waits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("value", T.DoubleType())]))
        self.seen = handle.getValueState("seen", T.StructType([T.StructField(c, T.LongType()) for c in ("pieces", "newest")]))
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField(c, T.LongType()) for c in ("hour", "piece")]), HOUR_STATE)

    def _put(self, hour: int, piece: int, us: np.ndarray, value: np.ndarray, side: np.ndarray) -> None:
        self.waiting.updateValue((hour, piece), (us.tobytes(), value.tobytes(), side.tobytes()))

    def _keep(self, frames: list[pd.DataFrame]) -> None:
        rows = pd.concat(frames, ignore_index=True)
        rows = rows[rows["us"].notna()]
        if not len(rows):
            return
        us, value, side = rows["us"].to_numpy(dtype="int64"), rows["value"].to_numpy(dtype=float), rows["is_side"].to_numpy(dtype=bool)
        pieces, newest = self.seen.get() if self.seen.exists() else (0, us[0])
        hours = us // _HOUR
        order = np.argsort(hours, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(hours[order])) + 1):
            self._put(int(hours[at[0]]), int(pieces), us[at], value[at], side[at])
        self.seen.update((int(pieces) + 1, int(max(newest, us.max()))))

    def _settle(self, key: Any, watermark: int) -> Iterator[pd.DataFrame]:
        passed = watermark * 1000
        value = self.last.get()[0] if self.last.exists() else None
        waiting = sorted((int(h), int(p)) for h, p in self.waiting.keys())  # noqa: SIM118
        for hour, pieces in itertools.groupby(waiting, key=lambda k: k[0]):
            if hour * _HOUR > passed:
                break
            held = [(k, self.waiting.getValue(k)) for k in pieces]
            us, values, side = (np.concatenate([np.frombuffer(bytes(v[c]), dtype=kind) for _, v in held]) for c, kind in enumerate(("int64", "float64", "bool")))
            order = np.lexsort((~side, us))
            us, values, side = us[order], values[order], side[order]
            ready = int(np.searchsorted(us, passed, side="right"))
            for k, _ in held:
                self.waiting.removeKey(k)
            if ready < len(us):
                self._put(hour, held[0][0][1], us[ready:], values[ready:], side[ready:])
            us, values, side = us[:ready], values[:ready], side[:ready]
            source = np.maximum.accumulate(np.where(side, np.arange(ready), -1))
            known = np.where(source >= 0, values[source], np.nan if value is None else value) if ready else values
            prices = ~side
            symbol = np.full(int(prices.sum()), key[0], dtype=object)  # plain objects: pieces of Arrow strings would not join
            yield pd.DataFrame({"symbol": pd.Series(symbol, dtype=object), "us": us[prices], "close": values[prices], "side_value": known[prices]})
            if ready and source[-1] >= 0:
                value = float(values[source[-1]])
        if value is not None:
            self.last.update((value,))
        newest = self.seen.get()[1] if self.seen.exists() else None
        if newest is not None and newest > passed:
            self.handle.registerTimer(int(newest) // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in rows:
            held.append(frame)
            n += len(frame)
            if n >= _ROWS_AT_ONCE:
                self._keep(held)
                held, n = [], 0
        if held:
            self._keep(held)
        yield from self._settle(key, timers.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def asof_enrich(prices: DataFrame, side: DataFrame, late: str = "1 hour") -> DataFrame:
    """Streaming prices (symbol, ts, close) with the last side value (symbol, ts, value) up to their time.

    A price row is emitted once the watermark (``late`` behind the newest time) has passed it: rows of either side may be that late.
    """
    both = prices.select("symbol", "ts", F.col("close").alias("value"), F.lit(False).alias("is_side")).unionByName(
        side.select("symbol", "ts", "value", F.lit(True).alias("is_side")))
    both = both.withWatermark("ts", late).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    out = both.groupBy("symbol").transformWithStateInPandas(LastKnown(), "symbol string, us long, close double, side_value double", "append", "EventTime")
    return out.select("symbol", F.timestamp_micros("us").alias("ts"), "close", "side_value")

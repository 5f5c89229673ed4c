"""Structured Streaming versions (ST*).

A streaming query writes Parquet under the shared folder and keeps its
checkpoint there; nothing is gathered on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlens.functions.core import div
from barlens.operators.regime import filtered, two_sided
from barlens.session import configure, scratch_path, written
from barlens.sources.keyed import KeyedTable
from barlens.sources.tables import ticks_from

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def tick_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """Ticks as a file stream of the events table."""
    configure(spark)
    path = os.path.join(sf_dir, "events.parquet")
    table = spark.read.parquet(path)
    schema = table.schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    # a stream source is a folder: the table itself, or the folder that holds it as one file
    single = all(f.endswith("/events.parquet") for f in table.inputFiles())
    e = r.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else r.parquet(path)
    for f in schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            e = e.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return ticks_from(e)


def folder_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Event time of end markers.  Rows of this time or later are markers, not data.
END_OF_INPUT = "2200-01-01"


class Bounded:
    """A stream that can be told that its input is over.

    ``rows`` is the stream together with a folder of end markers, empty at first.  :meth:`close` puts one marker row there,
    dated far ahead, with NULL in all other columns.  It reaches the watermark of its source like any row, so when the query goes
    on, every window, bucket and timer before it is due; the operators leave markers out behind the watermark.
    The folder is a source of its own, so neither a read-only input nor the order of its files matters.
    """

    def __init__(self, stream: DataFrame, time: str = "ts"):
        self.spark, self.time, self.schema = stream.sparkSession, time, stream.schema
        self.path = scratch_path(self.spark, "end-of-input")
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        self.rows = stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.path))

    def close(self) -> None:
        at = F.to_timestamp(F.lit(END_OF_INPUT))
        marker = [at.alias(f.name) if f.name == self.time else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.spark.range(1).select(*marker).coalesce(1).write.mode("append").parquet(self.path)


def watched(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows behind a watermark, end markers left out.  The condition reads the event time, so it stays behind the watermark."""
    return df.withWatermark(time, delay).filter(F.col(time) < F.lit(END_OF_INPUT).cast("timestamp"))


def run_to_table(df: DataFrame | Finals, name: str, mode: str = "append", late: list[int] | None = None, closing: Sequence[Bounded] = ()) -> DataFrame:
    """Run a stream over what is there now and return its output table.

    ``closing``: bounded inputs of the stream.  When what is there has been read, they are closed and the query goes on from its
    checkpoint, so what waited for the watermark comes out as well and nothing is left in state.
    ``late`` gets the number of rows that came behind the watermark and were dropped.
    """
    steps = df if isinstance(df, Finals) else None
    stream = steps.stream if steps else df
    spark = stream.sparkSession
    out, chk = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-chk")
    if steps:
        spark.createDataFrame([], steps.schema).write.parquet(f"{out}/epoch=-1")  # there may be no batch at all
        batch = _through_steps(steps, out, name)
    dropped = 0
    for ending in ([False, True] if closing else [False]):
        if ending:
            for b in closing:
                b.close()
        w = stream.writeStream.foreachBatch(batch) if steps else stream.writeStream.format("parquet").option("path", out)
        q = w.option("checkpointLocation", chk).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    if late is not None:
        late.append(dropped)
    if steps:
        return spark.read.schema(T.StructType([*steps.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(out).drop("epoch")
    return spark.read.schema(df.schema).parquet(out)


def stream_bars(ticks: DataFrame, freq: str, delay: str) -> DataFrame:
    """Bars of closed windows; ticks later than ``delay`` behind the newest are dropped."""
    at = F.struct("ts", "event_id")
    g = watched(ticks, "ts", delay).groupBy("symbol", F.window("ts", freq)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"))
    return g.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count")


def sliding_tick_features(ticks: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Overlapping windows: volume imbalance and VWAP."""
    s, buy = F.col("size"), F.col("side") == "buy"
    g = watched(ticks, "ts", delay).groupBy("symbol", F.window("ts", size, slide)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(s).alias("volume"), F.sum(F.when(buy, s).otherwise(-s)).alias("_d"), F.sum(F.col("price") * s).alias("_pv"))
    return g.select("symbol", F.col("window.start").alias("ts"), "n", "volume", div("_d", "volume").alias("imbalance"), div("_pv", "volume").alias("vwap"))


def activity_sessions(ticks: DataFrame, gap: str, delay: str) -> DataFrame:
    g = watched(ticks, "ts", delay).groupBy("symbol", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


def dedup_stream(ticks: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_upsert(stream: DataFrame, name: str, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key: every micro-batch is merged into the parts of a keyed table that it touches.

    A batch that is retried is found in the table's log and changes nothing.
    """
    spark = stream.sparkSession
    table = KeyedTable(spark, scratch_path(spark, f"{name}-out"), keys, order)
    chk = scratch_path(spark, f"{name}-chk")
    stream.writeStream.foreachBatch(lambda batch, epoch: table.upsert(batch, f"{epoch:08d}") and None) \
        .option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    return table.read()


def staleness_flag(bars: DataFrame, as_of, limit: str) -> DataFrame:
    """Last bar per symbol and whether it is older than ``limit``, for a table; :func:`staleness_events` is the stream's."""
    now = F.lit(as_of).cast("timestamp")
    g = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    return g.withColumns({"age_minutes": (F.unix_seconds(now) - F.unix_seconds("last_ts")) / 60.0,
                          "is_stale": F.col("last_ts") < now - F.expr(f"interval {limit}")})


# ---- arbitrary state ------------------------------------------------------------

def _in_order(df: DataFrame, keys: list[str], step: Callable, order: list[str], schema: str, bucket: str = "1 day") -> DataFrame:
    use_rocksdb(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(_InOrder(step, order, int(pd.Timedelta(bucket).value // 1_000_000)), schema, "append", "EventTime")


class _InOrder(StatefulProcessor):
    """The rows of a key in event time through ``step(rows, state) -> (frame, state)``; the state is a list of doubles.

    Rows wait in buckets of event time, one entry per bucket and batch, until the watermark has passed the bucket: then no
    row of it can come any more, and a timer hands the bucket on, sorted.  So neither the cut into micro-batches nor the
    order of arrival changes the result.  Buckets that are due together go through ``step`` in one call as long as their rows
    are few, so short buckets cost no call each, and at most that many rows or one bucket of a key are in memory.  Rows behind
    the watermark are dropped and counted by Spark.
    """

    ROWS = 100_000

    def __init__(self, step: Callable, order: list[str], bucket_ms: int):
        self.step, self.order, self.bucket = step, order, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "v array<double>")
        self.parts = handle.getValueState("parts", "n long")
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.parts.get()
        part = held[0] if held is not None else 0
        pdf = pd.concat(list(rows))
        bucket = pdf[self.order[0]].to_numpy("datetime64[us]").astype("int64") // 1000 // self.bucket
        for b, some in pdf.groupby(bucket):
            table = pa.Table.from_pandas(some, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            self.waiting.updateValue((int(b), part), (sink.getvalue().to_pybytes(),))
            part += 1
        self.handle.registerTimer((int(bucket.min()) + 1) * self.bucket)
        self.parts.update((part,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        found = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        held = self.state.get()
        state, after = (list(held[0]) if held is not None else None), None
        due: list[pd.DataFrame] = []

        def through(state):
            out, state = self.step(pd.concat(due).sort_values(self.order).reset_index(drop=True), state)
            due.clear()
            return out, state

        for b, mine in groupby(found, lambda k: k[0]):
            if (b + 1) * self.bucket > passed:
                after = b
                break
            for k in mine:
                due.append(pa.ipc.open_stream(self.waiting.getValue(k)[0]).read_pandas())
                self.waiting.removeKey(k)
            if sum(map(len, due)) >= self.ROWS:
                out, state = through(state)
                if len(out):
                    yield out
        if due:
            out, state = through(state)
            if len(out):
                yield out
        if state is not None:
            self.state.update((state,))
        if after is not None:
            self.handle.registerTimer((after + 1) * self.bucket)

    def close(self) -> None:
        pass


class _Gaps:
    """Rows of a key in time order: fresh with the first, stale once ``limit`` has passed without a row, fresh again with the next.

    State: microseconds of the last row, and 1 once the key has been told stale after it.
    """

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def __call__(self, pdf: pd.DataFrame, state):
        at = pdf["ts"].to_numpy("datetime64[us]").astype("int64")
        before = np.concatenate([[state[0] if state else np.nan], at[:-1].astype(float)])
        told = np.zeros(len(at))
        told[0] = state[1] if state else 0
        silent = at - before > self.limit  # False for the first row of all
        fresh = silent | np.isnan(before)
        ends = np.where(silent & (told == 0))[0]
        starts = np.where(fresh)[0]
        out = pd.concat([self.rows(pdf["symbol"].iloc[0], before[ends] + self.limit, "STALE", before[ends]), self.rows(pdf["symbol"].iloc[0], at[starts], "FRESH", at[starts])])
        return out.sort_values("ts"), [float(at[-1]), 0.0]

    @staticmethod
    def rows(symbol, at, status, last) -> pd.DataFrame:
        stamp = [np.asarray(x).astype("int64").astype("datetime64[us]") for x in (at, last)]
        return pd.DataFrame({"symbol": symbol, "ts": stamp[0], "status": status, "last_ts": stamp[1]})


class _Staleness(_InOrder):
    """:class:`_Gaps` with a timer for keys that send nothing: it fires when the watermark has passed the end of the limit's bucket."""

    def __init__(self, limit_us: int, bucket_ms: int):
        super().__init__(_Gaps(limit_us), ["ts"], bucket_ms)
        self.limit = limit_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        held = self.state.get()
        if held is None:
            return
        last, told = held[0]
        # every row up to the limit has been handed on once the bucket that holds the limit is over
        due = (int(last + self.limit) // 1000 // self.bucket + 1) * self.bucket
        if told == 0 and passed >= due:
            self.state.update(([last, 1.0],))
            yield _Gaps.rows(key[0], np.array([last + self.limit]), "STALE", np.array([last]))
        elif told == 0:
            self.handle.registerTimer(due)


def staleness_events(bars: DataFrame, limit: str, delay: str = "0 seconds", bucket: str = "1 minute") -> DataFrame:
    """(symbol, ts, status, last_ts) of a stream: FRESH when a symbol first sends or returns, STALE once it has been silent for longer than ``limit``.

    A symbol that sends nothing is told stale by a timer in event time, so the rows of the other symbols are enough.  Neither
    batches nor the order of arrival within ``delay`` change the rows.
    """
    use_rocksdb(bars.sparkSession)
    rows = watched(bars.select("symbol", "ts"), "ts", delay)
    us = int(pd.Timedelta(limit).value // 1000)
    return rows.groupBy("symbol").transformWithStateInPandas(_Staleness(us, int(pd.Timedelta(bucket).value // 1_000_000)),
                                                             "symbol string, ts timestamp, status string, last_ts timestamp", "append", "EventTime")


class OnlineRegime:
    """CUSUM, volatility state and percentile regime of bars as they come, on the scans of ``operators.regime``.

    The volatility levels start from the first returns, on the first bar after the warm-up; the thresholds of the
    percentile regime are linear percentiles of the latest returns, on that bar of the first.
    State: bars seen, last close, sums above and below, whether levels exist, log odds, levels, and the first and the latest sizes
    of returns with their counts.
    """

    SCHEMA = ("symbol string, ts timestamp, cusum_positive double, cusum_negative double, cusum_signal double, "
              "hmm_vol_state double, hmm_vol_probability double, volatility_regime double")

    def __init__(self, threshold=5.0, drift=0.0, window=20, stay=0.85, factor=2.0, regime_window=20, lo=33.0, hi=67.0):
        self.cusum, self.filter = (threshold, drift), (stay, factor)
        self.window, self.regime_window, self.cuts = window, regime_window, (lo, hi)
        self.size = max(window, regime_window)

    def __call__(self, pdf: pd.DataFrame, state):
        seen, close, up, down, begun, odds, low, high, n_first, n_last, *kept = state or [0, np.nan, 0, 0, 0, 0, 0, 0, 0, 0]
        first, last = np.array(kept[:int(n_first)]), np.array(kept[int(n_first):])
        price = pdf["close"].to_numpy(float)
        before = np.concatenate([[close], price[:-1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(before > 0, np.log(price / before), np.nan)
        rows = np.flatnonzero(before > 0)
        r, bars = r[rows], seen + rows + 1
        out = pd.DataFrame(np.nan, index=range(len(pdf)), columns=[c.split()[0] for c in self.SCHEMA.split(", ")[2:]])
        above, below, hit, (up, down) = two_sided(r, (up, down), *self.cusum)
        out.iloc[rows, 0:3] = np.column_stack([above, below, hit])
        sizes = np.concatenate([last, np.abs(r)])
        warm = np.flatnonzero(bars >= self.size + 2)
        if len(warm):
            first = np.concatenate([first, np.abs(r)])[:self.size] if len(first) < self.size else first
            if not begun:
                low, q3 = np.percentile(first[:self.window], [25.0, 75.0])
                high = max(q3 * 1.5, low * self.filter[1])
                high = high if high > low else low * self.filter[1]
            p, odds, low, high = filtered(r[warm], float(odds), float(low), float(high), *self.filter)
            out.iloc[rows[warm], 3:5] = np.column_stack([(p > 0.5).astype(float), p])
            ends = len(last) + warm + 1
            cuts = np.array([np.percentile(sizes[max(0, e - self.regime_window):e], self.cuts) for e in ends[:self.regime_window]])
            if len(ends) > self.regime_window:
                view = np.lib.stride_tricks.sliding_window_view(sizes, self.regime_window)
                cuts = np.concatenate([cuts, np.percentile(view[ends[self.regime_window:] - self.regime_window], self.cuts, axis=1).T])
            if not begun:
                cuts[0] = np.percentile(first[:self.regime_window], self.cuts)
            a = np.abs(r[warm])
            out.iloc[rows[warm], 5] = np.where(a <= cuts[:, 0], 0.0, np.where(a >= cuts[:, 1], 2.0, 1.0))
            begun = 1
        elif len(first) < self.size:
            first = np.concatenate([first, np.abs(r)])[:self.size]
        last = sizes[-self.size:]
        state = [seen + len(price), price[-1], up, down, begun, odds, low, high, len(first), len(last), *first, *last]
        return pd.concat([pdf[["symbol", "ts"]], out], axis=1), [float(v) for v in state]


def online_regime(bars: DataFrame, delay: str = "0 seconds", **params) -> DataFrame:
    return _in_order(watched(bars, "ts", delay), ["symbol"], OnlineRegime(**params), ["ts"], OnlineRegime.SCHEMA)


@dataclass(frozen=True)
class Finals:
    """A stream of final rows and the batch job each micro-batch of it goes through.

    ``step(batch, carry) -> (rows, carry)`` gets the carry of the batch before, None at first; a carry is a small table.
    """

    stream: DataFrame
    schema: T.StructType
    step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def _through_steps(finals: Finals, out: str, name: str) -> Callable[[DataFrame, int], None]:
    """Output and carry of an epoch lie in folders of their own, so a batch that is retried writes the same again."""
    spark, carries = finals.stream.sparkSession, scratch_path(finals.stream.sparkSession, f"{name}-carry")
    before: list[str] = []

    def batch(rows: DataFrame, epoch: int) -> None:
        at = f"{carries}/{epoch:08d}"
        kept = [p for p in before if p < at]
        made, carry = finals.step(rows, spark.read.parquet(kept[-1]) if kept else None)
        carry.coalesce(1).write.mode("overwrite").parquet(at)
        made.write.mode("overwrite").parquet(f"{out}/epoch={epoch:08d}")
        before.append(at)

    return batch


def rolling_circuit_state(trades: DataFrame, n: int = 20, delay: str = "0 seconds", bucket: str = "1 day") -> Finals:
    """Failure share and trailing losses among the last n closed trades of a mode after each trade.

    Trades wait in buckets of event time until the watermark has passed them, so neither the cut into micro-batches nor the order
    of arrival changes the result.  A bucket is worked on its own behind the last n - 1 trades before it; only those tails meet per mode.
    """
    use_rocksdb(trades.sparkSession)
    lost = F.coalesce(F.col("realized_r") <= 0, F.lit(False)).alias("lost")
    t = watched(trades, "closed_at", delay).groupBy("mode", F.window("closed_at", bucket).alias("w")).agg(
        F.collect_list(F.struct("closed_at", "order_id", lost)).alias("rows"))
    kinds = {f.name: f.dataType for f in trades.schema.fields}
    schema = T.StructType([T.StructField(x, kinds[x]) for x in ("mode", "closed_at", "order_id")]).add("failure_rate", "double").add("loss_streak", "long").add("analyzed", "long")
    return Finals(t.select("mode", F.col("w.start").alias("bucket"), "rows"), schema, lambda batch, carry: _circuit_buckets(batch, carry, n))


def _last(x: Column, k: int) -> Column:
    return F.slice(x, F.greatest(F.size(x) - k + 1, F.lit(1)), k)


def _circuit_buckets(batch: DataFrame, carry: DataFrame | None, n: int) -> tuple[DataFrame, DataFrame]:
    b = written(batch, "buckets")
    tails = b.select("mode", "bucket", _last(F.array_sort("rows"), n - 1).alias("tail"))
    if carry is not None:
        tails = tails.unionByName(carry)
    w = Window.partitionBy("mode").orderBy(F.col("bucket").asc_nulls_first())
    # a bucket has at least one trade, so n - 1 buckets before it are enough
    tails = written(tails.withColumn("head", _last(F.flatten(F.collect_list("tail").over(w.rowsBetween(-max(n - 1, 1), -1))), n - 1)), "tails")
    carry = tails.groupBy("mode").agg(F.max_by(_last(F.concat("head", "tail"), n - 1), F.coalesce("bucket", F.lit("0001-01-01").cast("timestamp"))).alias("tail")) \
        .select("mode", F.lit(None).cast("timestamp").alias("bucket"), "tail")
    heads = tails.where(F.col("bucket").isNotNull()).select("mode", "bucket", F.col("head").alias("rows"), F.lit(False).alias("own"))
    r = b.select("mode", "bucket", "rows", F.lit(True).alias("own")).unionByName(heads).select("mode", "bucket", "own", F.inline("rows"))
    o = Window.partitionBy("mode", "bucket").orderBy("closed_at", "order_id", "lost")
    r = r.withColumn("_i", F.row_number().over(o).cast("long"))
    streak = F.col("_i") - F.coalesce(F.max(F.when(~F.col("lost"), F.col("_i"))).over(o.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    r = r.withColumns({"analyzed": F.least("_i", F.lit(n)), "_n": F.count(F.when(F.col("lost"), 1)).over(o.rowsBetween(1 - n, 0)), "_s": streak})
    return r.where("own").select("mode", "closed_at", "order_id", (100.0 * F.col("_n") / F.col("analyzed")).alias("failure_rate"),
                                 F.least("_s", "analyzed").alias("loss_streak"), "analyzed"), carry


class _LastKnown:
    """The overlay value at or before each base row of a key (side 0 overlay, side 1 base)."""

    def __call__(self, pdf: pd.DataFrame, state):
        base = (pdf["side"] == 1).to_numpy()
        held = pdf["value"].astype(float).where(~base).ffill().fillna(state[0] if state else np.nan)
        out = pdf.loc[base, ["symbol", "ts", "event_id"]].assign(rate=held[base].to_numpy())
        return out, [float(held.iloc[-1])]


def stream_asof(base: DataFrame, overlay: DataFrame, value: str, delay: str = "0 seconds") -> DataFrame:
    """As-of join on a stream by state: both sides merged in event time, the last overlay value held per key.

    Each side has a watermark of its own and the lesser one counts, so base rows wait for an overlay that lags behind.
    """
    b = watched(base, "ts", delay).select("symbol", "ts", "event_id", F.lit(None).cast("double").alias("value"), F.lit(1).alias("side"))
    o = watched(overlay, "ts", delay).select("symbol", "ts", F.lit(-1).cast("long").alias("event_id"), F.col(value).alias("value"), F.lit(0).alias("side"))
    return _in_order(b.unionByName(o), ["symbol"], _LastKnown(), ["ts", "side", "event_id"], "symbol string, ts timestamp, event_id long, rate double")


__all__ = ["use_rocksdb", "tick_stream", "folder_stream", "Bounded", "END_OF_INPUT", "watched", "run_to_table", "stream_bars", "sliding_tick_features", "activity_sessions", "dedup_stream", "stream_upsert",
           "staleness_flag", "staleness_events", "OnlineRegime", "online_regime", "rolling_circuit_state", "stream_asof"]

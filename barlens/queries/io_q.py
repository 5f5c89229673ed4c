"""Queries: sources and sinks (IO*) and streaming (ST*)."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from barlens.operators import labels as LB
from barlens.queries.context_q import cusum_sql
from barlens.queries.features_q import win
from barlens.queries.labels_q import blocked_bars
from barlens.queries.registry import cte, query
from barlens.session import scratch_path
from barlens.sources import files as IO, tables as S
from barlens.sources.keyed import KeyedTable
from barlens.streaming import streams as ST


def _bars_path(spark, d):
    """Bars written twice for a few days, so that reading must drop duplicates."""
    path = scratch_path(spark, "bars")
    b = S.bars(spark, d).withColumns({"interval": F.lit("4h"), "load": F.lit(1)})
    IO.write_bars(b, path)
    IO.write_bars(b.filter(F.day("ts") < 5).withColumns({"load": F.lit(2), "close": F.col("close") + 1}), path)
    return path


_B = "symbol interval ts@ open#2 high#2 low#2 close#2 volume#2"
_DUP = "SELECT symbol, '4h' AS interval, ts, open, high, low, close + CASE WHEN day(ts) < 5 THEN 1 ELSE 0 END AS close, volume FROM bars_4h"


@query("IO1_read_bars", _B, f"SELECT * FROM ({_DUP}) WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' AND symbol IN ('S00', 'S01', 'S07')")
def _(spark, d):
    return IO.read_bars(spark, _bars_path(spark, d), "4h", "2024-01-03", "2024-01-20", ["S00", "S01", "S07"], ["load"])


def _funding_path(spark, d):
    path = scratch_path(spark, "funding")
    IO.write_funding(S.funding(spark, d).select("symbol", "ts", F.format_number(F.col("rate") * 1e6, 4).alias("funding_rate"), F.lit("x").alias("source")), path)
    return path


@query("IO2_read_funding", "symbol ts@ funding_rate#3", """
SELECT g.symbol, g.ts, round(f.rate * 1e6, 4) AS funding_rate FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM funding WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY symbol) g
ASOF JOIN (SELECT * FROM funding WHERE ts >= TIMESTAMP '2024-01-05') f ON g.symbol = f.symbol AND g.ts >= f.ts""")
def _(spark, d):
    return IO.read_funding(spark, _funding_path(spark, d), "2024-01-05", "2024-01-25")


@query("IO3_read_funding_partitions", "symbol ts@ source", "SELECT symbol, ts, 'x' AS source FROM funding WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def _(spark, d):
    return IO.read_funding_partitions(spark, _funding_path(spark, d), "2024-01-10", "2024-01-12")


@query("IO4_write_bars", "interval month n! close_sum#2", "SELECT '4h' AS interval, strftime(ts, '%Y-%m') AS month, count(*) + count(CASE WHEN day(ts) < 5 THEN 1 END) AS n, sum(close) + sum(CASE WHEN day(ts) < 5 THEN close + 1 ELSE 0 END) AS close_sum FROM bars_4h GROUP BY 2")
def _(spark, d):
    return spark.read.parquet(_bars_path(spark, d)).groupBy("interval", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("close_sum"))


@query("IO5_write_funding", "year! month! n!", "SELECT year(ts) AS year, month(ts) AS month, count(*) AS n FROM funding GROUP BY 1, 2")
def _(spark, d):
    return spark.read.parquet(_funding_path(spark, d)).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("IO6_read_jsonl_ledger", "key! ts@ value#2", """
SELECT event_id % 500 AS key, max(ts) AS ts, arg_max(value, ts) AS value FROM events WHERE event_id % 7 <> 0 AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "ledger")
    e = S.load(spark, d, "events")
    line = F.to_json(F.struct((F.col("event_id") % 500).alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), "value"))
    e.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"key": broken '), line)).otherwise(line).alias("value")).write.text(path)
    return IO.read_jsonl_ledger(spark, path, "key long, ts timestamp, value double", "ts", "10 days", F.lit("2024-01-30").cast("timestamp"), "key")


@query("IO7_append_jsonl_ledger", "symbol n! keys!", "SELECT symbol, count(*) * 2 AS n, count(*) AS keys FROM bars_4h GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "ledger")
    b = S.bars(spark, d).select("symbol", "ts", "close")
    for _i in range(2):
        IO.append_jsonl_ledger(b, path, ["symbol", "ts"])
    r = spark.read.schema("symbol string, ts timestamp, close double, key string").json(path)
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


@query("IO8_read_signal_events_csv", "event_id symbol ts@ direction entry_price#2", """
SELECT concat('e', event_id) AS event_id, symbol, date_trunc('second', ts) AS ts, upper(side) AS direction, price AS entry_price FROM ticks""")
def _(spark, d):
    path = scratch_path(spark, "signals")
    t = S.ticks(spark, d).select(F.concat(F.lit("e"), "event_id").alias("event_id"), F.lit("a").alias("alpha_name"), "symbol", F.date_trunc("second", "ts").alias("ts"),
                                 F.upper("side").alias("direction"), F.lit(0.5).alias("signal_value"), F.col("price").alias("entry_price"), F.lit(1.0).alias("atr"))
    IO.write_csv(t, path)
    return IO.read_signal_events_csv(spark, path)


@query("IO9_read_panel_files", "ts@ symbol open#2 high#2 low#2 close#2 volume#2", "SELECT ts, symbol, open, high, low, close, volume FROM bars_4h")
def _(spark, d):
    b, paths = S.bars(spark, d), {}
    syms = [f"S{i:02d}" for i in range(20)]
    for f in ("open", "high", "low", "close", "volume"):
        paths[f] = scratch_path(spark, f"panel-{f}")
        if f in ("open", "volume"):  # long files
            b.select("ts", "symbol", F.col(f).alias(f if f == "open" else "value")).write.parquet(paths[f])
        else:
            b.groupBy("ts").pivot("symbol", syms).agg(F.first(f)).write.parquet(paths[f])
    return IO.read_panel_files(spark, paths)


@query("IO4_checksums", "state", "SELECT unnest(['ok', 'new']) AS state")
def _(spark, d):
    path = scratch_path(spark, "bars")
    b = S.bars(spark, d).withColumn("interval", F.lit("4h"))
    for lo, hi in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-11")):
        IO.write_bars(b.filter((F.col("ts") >= lo) & (F.col("ts") < hi)), path, checksums=True)
    IO.write_bars(b.filter(F.day("ts") == 2), path)
    return IO.verify_checksums(spark, path).select("state").distinct()


cte("oc", "SELECT symbol, closed_at AS ts, concat(mode, '_', source) AS alpha_id, order_id, realized_r AS net_r FROM trades")


def _cache(spark, d):
    path = scratch_path(spark, "outcomes")
    IO.outcome_cache_write(S.trades(spark, d).select("symbol", F.col("closed_at").alias("ts"), F.concat_ws("_", "mode", "source").alias("alpha_id"), "order_id",
                                                     F.col("realized_r").alias("net_r")), path)
    return path


@query("IO10_outcome_cache_write", "symbol n!", "SELECT symbol, count(*) AS n FROM trades GROUP BY 1")
def _(spark, d):
    return spark.read.parquet(_cache(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("IO11_outcome_cache_query", "order_id symbol alpha_id net_r#4", "SELECT * FROM oc WHERE symbol = 'K03' AND alpha_id = 'SCALP_HIGH' AND net_r > 0.2")
def _(spark, d):
    return IO.outcome_cache_query(spark, _cache(spark, d), "SCALP_HIGH", "K03", "net_r > 0.2")


@query("IO12_outcome_cache_summary", "alpha_id symbol n! win_rate# avg_r#", "SELECT alpha_id, symbol, count(*) AS n, avg(CASE WHEN net_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(net_r) AS avg_r FROM oc GROUP BY 1, 2")
def _(spark, d):
    return IO.outcome_cache_summary(IO.outcome_cache_query(spark, _cache(spark, d)), ["alpha_id", "symbol"])


@query("IO13_candles", "kind symbol ts@ close#2", """
SELECT 'between' AS kind, symbol, ts, close FROM bars_4h WHERE symbol = 'S04' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' UNION ALL (SELECT 'latest', symbol, ts, close FROM bars_4h WHERE symbol = 'S04' ORDER BY ts DESC LIMIT 20)""")
def _(spark, d):
    b = S.bars(spark, d).select("symbol", "ts", "close")
    x = IO.candles_between(b, "S04", "2024-01-05", "2024-01-09").withColumn("kind", F.lit("between"))
    return x.unionByName(IO.latest_candles(b, "S04", 20).withColumn("kind", F.lit("latest")))


@query("IO14_upsert_candles", "symbol ts@ close#2", "SELECT symbol, ts, CASE WHEN day(ts) >= 20 AND symbol <> 'S03' THEN close * 2 ELSE close END AS close FROM bars_4h")
def _(spark, d):
    b = S.bars(spark, d).select("symbol", "ts", "close")
    new = b.filter((F.day("ts") >= 20) & (F.col("symbol") != "S03")).withColumn("close", F.col("close") * 2)
    return IO.upsert_candles(b.filter((F.day("ts") < 25) | (F.col("symbol") == "S03")), new, ["symbol", "ts"])


@query("IO14_upsert_in_place", "symbol ts@ close#2", "SELECT symbol, ts, CASE WHEN day(ts) >= 20 AND symbol <> 'S03' THEN close * 2 ELSE close END AS close FROM bars_4h")
def _(spark, d):
    b = S.bars(spark, d).select("symbol", "ts", "close")
    t = KeyedTable(spark, scratch_path(spark, "candles"), ["symbol", "ts"], [], lambda: F.date_format("ts", "yyyy-MM-dd"))
    new = b.filter((F.day("ts") >= 20) & (F.col("symbol") != "S03")).withColumn("close", F.col("close") * 2)
    for batch, rows in (("day-1", b.filter((F.day("ts") < 25) | (F.col("symbol") == "S03"))), ("day-2", new), ("day-2", new)):
        t.upsert(rows, batch)
    return t.read()


@query("IO15_leaderboard_csv", "mode source n! avg_r#4", "SELECT mode, source, count(*) AS n, round(avg(realized_r), 6) AS avg_r FROM trades GROUP BY 1, 2")
def _(spark, d):
    path = scratch_path(spark, "board")
    g = S.trades(spark, d).groupBy("mode", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("realized_r"), 6).alias("avg_r"))
    IO.write_csv(g, path, [F.desc("avg_r")])
    return spark.read.schema("mode string, source string, n long, avg_r double").option("header", True).csv(path)


@query("IO16_flatten_outcomes", "symbol ts@ long_exit_reason long_gross_r# short_exit_reason short_gross_r#", """
SELECT l.symbol, l.ts, l.exit_reason AS long_exit_reason, l.gross_r AS long_gross_r, s.exit_reason AS short_exit_reason, s.gross_r AS short_gross_r FROM lbs_long l JOIN lbs_short s USING (symbol, rn)""")
def _(spark, d):
    return IO.flatten_outcomes(LB.barrier_label(blocked_bars(spark, d)).select("symbol", "ts", "long", "short"))


@query("IO17_analytics_export", "order_id symbol mode realized_r#4 close_reason", "SELECT order_id, symbol, mode, realized_r, close_reason FROM trades")
def _(spark, d):
    path = scratch_path(spark, "export")
    cols = ["order_id", "symbol", "mode", "realized_r", "close_reason"]
    IO.write_csv(S.trades(spark, d).select(*cols), path)
    return spark.read.schema("order_id string, symbol string, mode string, realized_r double, close_reason string").option("header", True).csv(path)


@query("IO18_read_trace_jsonl", "kind n! ids!", """
SELECT CASE WHEN event_id % 11 = 0 THEN 'unreadable' WHEN k = 0 THEN 'exit_not_after_entry' ELSE 'valid' END AS kind, count(*) AS n, sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id END) AS ids FROM ticks GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "trace")
    fmt = "yyyy-MM-dd'T'HH:mm:ssXXX"
    t = S.ticks(spark, d)
    line = F.to_json(F.struct("event_id", "symbol", F.date_format("ts", fmt).alias("entry_ts"), F.date_format(F.timestamp_add("HOUR", F.col("k"), F.col("ts")), fmt).alias("exit_ts")))
    t.select(F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{bad "), line)).otherwise(line).alias("value")).write.text(path)
    ok, bad = IO.read_trace_jsonl(spark, path, "event_id long, symbol string, entry_ts timestamp, exit_ts timestamp")
    u = ok.select(F.lit("valid").alias("kind"), "event_id").unionByName(bad.select(F.col("reason").alias("kind"), "event_id"))
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))


# ---- streaming -------------------------------------------------------------------------

def _in_files(df, name, cuts):
    """A folder with one file per span of time, the spans given by their first instants."""
    path = scratch_path(df.sparkSession, name)
    for lo, hi in zip(cuts, [*cuts[1:], "2100-01-01"]):
        df.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(path)
    return path


_THIRDS = ["1970-01-01", "2024-01-11", "2024-01-21"]


def _closed(stream, build, name, time="ts"):
    """A stream run to the end of its input, so that the newest rows come out too."""
    b = ST.Bounded(stream, time)
    return ST.run_to_table(build(b.rows), name, closing=[b])


cte("cu5_e", cusum_sql(5, "cu5_e"))
cte("lv4", f"""
SELECT *, quantile_cont(abs(ret), 0.33) OVER w AS lo, quantile_cont(abs(ret), 0.67) OVER w AS hi FROM r4 WINDOW w AS {win(20)}""")


@query("ST1_online_regime", "symbol ts@ cusum_positive# cusum_signal#1 hmm_vol_state#1 hmm_vol_probability#4 volatility_regime#1", """
SELECT r.symbol, r.ts, CASE WHEN r.rn > 0 THEN e.up END AS cusum_positive, e.sig AS cusum_signal, CASE WHEN h.p > 0.5 THEN 1 WHEN h.p IS NOT NULL THEN 0 END AS hmm_vol_state,
 h.p AS hmm_vol_probability, CASE WHEN r.rn >= 21 THEN CASE WHEN abs(r.ret) <= v.lo THEN 0 WHEN abs(r.ret) >= v.hi THEN 2 ELSE 1 END END AS volatility_regime
FROM r4 r JOIN cu5_e e ON e.symbol = r.symbol AND e.rn = r.rn LEFT JOIN hmo_e h ON h.symbol = r.symbol AND h.rn = r.rn
LEFT JOIN lv4 v ON v.symbol = r.symbol AND v.rn = CASE WHEN r.rn = 21 THEN 20 ELSE r.rn END""")
def _(spark, d):
    x = S.bars(spark, d).select("symbol", "ts", "close")
    return _closed(ST.folder_stream(spark, _in_files(x, "bars", _THIRDS), x.schema, 1), lambda b: ST.online_regime(b, delay="1 day"), "regime")


@query("ST1_online_cusum", "symbol ts@ cusum_positive# cusum_negative# cusum_signal#1", """
SELECT r.symbol, r.ts, CASE WHEN r.rn > 0 THEN e.up END AS cusum_positive, CASE WHEN r.rn > 0 THEN abs(e.dn) END AS cusum_negative, e.sig AS cusum_signal
FROM r4 r JOIN cu_e e ON e.symbol = r.symbol AND e.rn = r.rn""")
def _(spark, d):
    x = S.bars(spark, d).select("symbol", "ts", "close")
    return _closed(ST.folder_stream(spark, _in_files(x, "bars", _THIRDS), x.schema, 1), lambda b: ST.online_regime(b, delay="1 day", threshold=2.0), "cusum")


@query("ST2_stream_bars", "symbol ts@ open#2 high#2 low#2 close#2 volume#2 trade_count!", """
SELECT symbol, ts, open, high, low, close, volume, trade_count FROM bars_4h""")
def _(spark, d):
    return _closed(ST.tick_stream(spark, d), lambda t: ST.stream_bars(t, "4 hours", "1 hour"), "bars")


# Spark counts late rows after the partial aggregation: one per symbol and window of a batch
@query("ST2_late_windows", "kind n!", "SELECT 'late' AS kind, count(*) AS n FROM bars_4h WHERE ts < TIMESTAMP '2024-01-11'")
def _(spark, d):
    t, late = S.ticks(spark, d), []
    path = scratch_path(spark, "ticks")
    for part in (F.col("ts") >= "2024-01-21", (F.col("ts") >= "2024-01-11") & (F.col("ts") < "2024-01-21"), F.col("ts") < "2024-01-11"):
        t.filter(part).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read by age
    ST.run_to_table(ST.stream_bars(ST.folder_stream(spark, path, t.schema, 1), "4 hours", "10 days"), "late", late=late)
    return spark.createDataFrame([("late", late[0])], "kind string, n long")


@query("ST3_sliding_tick_features", "symbol ts@ n! volume#2 imbalance# vwap#", """
SELECT symbol, s AS ts, count(*) AS n, sum(size) AS volume, sum(CASE WHEN side = 'buy' THEN size ELSE -size END) / sum(size) AS imbalance, sum(price * size) / sum(size) AS vwap FROM (
SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL '1 hour', date_trunc('hour', ts) - INTERVAL '2 hours', date_trunc('hour', ts) - INTERVAL '3 hours']) AS s FROM ticks) GROUP BY 1, 2""")
def _(spark, d):
    return _closed(ST.tick_stream(spark, d), lambda t: ST.sliding_tick_features(t, "4 hours", "1 hour", "1 hour"), "slide")


@query("ST4_activity_sessions", "symbol start_ts@ end_ts@ n!", """
SELECT symbol, min(ts) AS start_ts, max(ts) + INTERVAL '2 hours' AS end_ts, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS g FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS nw FROM ticks)) GROUP BY symbol, g""")
def _(spark, d):
    return _closed(ST.tick_stream(spark, d), lambda t: ST.activity_sessions(t, "2 hours", "1 hour"), "sessions")


@query("ST5_stream_upsert", "symbol ts@ price#2 event_id!", "SELECT symbol, max(ts) AS ts, arg_max(price, (ts, event_id)) AS price, arg_max(event_id, (ts, event_id)) AS event_id FROM ticks GROUP BY 1")
def _(spark, d):
    return ST.stream_upsert(ST.tick_stream(spark, d), "upsert", ["symbol"], ["ts", "event_id"])


@query("ST6_staleness_flag", "symbol last_ts@ age_minutes#2 is_stale?", """
SELECT *, (epoch(TIMESTAMP '2024-01-31') - epoch(last_ts)) / 60 AS age_minutes, last_ts < TIMESTAMP '2024-01-31' - INTERVAL '3 hours' AS is_stale FROM (SELECT symbol, max(ts) AS last_ts FROM bars_1h GROUP BY 1)""")
def _(spark, d):
    return ST.staleness_flag(S.bars(spark, d, "1 hour"), "2024-01-31", "3 hours")


@query("ST6_staleness_events", "symbol ts@ status last_ts@", """
SELECT symbol, ts + INTERVAL '3 hours' AS ts, 'STALE' AS status, ts AS last_ts FROM st6 WHERE nx IS NULL OR nx - ts > INTERVAL '3 hours'
UNION ALL SELECT symbol, ts, 'FRESH', ts FROM st6 WHERE pv IS NULL OR ts - pv > INTERVAL '3 hours'""",
       st6="SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS pv FROM bars_1h")
def _(spark, d):
    x = S.bars(spark, d, "1 hour").select("symbol", "ts")
    return _closed(ST.folder_stream(spark, _in_files(x, "hours", _THIRDS), x.schema, 1), lambda b: ST.staleness_events(b, "3 hours", delay="1 hour", bucket="1 hour"), "stale")


@query("ST7_rolling_circuit_state", "mode order_id failure_rate#4 loss_streak! analyzed!", f"""
SELECT mode, order_id, failure_rate, least(rn - coalesce(max(CASE WHEN realized_r > 0 THEN rn END) OVER (PARTITION BY mode ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), analyzed) AS loss_streak, analyzed
FROM (SELECT mode, order_id, closed_at, realized_r, row_number() OVER (PARTITION BY mode ORDER BY closed_at, order_id) AS rn,
 avg(CASE WHEN realized_r <= 0 THEN 100.0 ELSE 0 END) OVER w AS failure_rate, count(*) OVER w AS analyzed FROM trades WINDOW w AS {win(20).replace('symbol', 'mode').replace('ORDER BY ts', 'ORDER BY closed_at, order_id')})""")
def _(spark, d):
    path = scratch_path(spark, "trades")
    S.trades(spark, d).select("mode", "closed_at", "order_id", "realized_r").write.parquet(path)
    # the files are in no order of time, so one batch takes them all, however many
    return _closed(ST.folder_stream(spark, path, spark.read.parquet(path).schema, 1 << 30), lambda t: ST.rolling_circuit_state(t, delay="1 day"), "circuit", "closed_at")


@query("ST8_dedup_stream", "symbol ts@", "SELECT DISTINCT symbol, ts FROM coarse")
def _(spark, d):
    t = ST.tick_stream(spark, d).withColumn("ts", S.bucket("ts", "10 minutes")).select("symbol", "ts")
    return ST.run_to_table(ST.dedup_stream(t, ["symbol", "ts"], "60 days"), "dedup")


@query("ST9_stream_asof", "symbol event_id! rate#9", """
SELECT t.symbol, t.event_id, f.rate FROM ticks t ASOF LEFT JOIN funding f ON t.symbol = f.symbol AND t.ts >= f.ts""")
def _(spark, d):
    x = S.funding(spark, d)  # the overlay comes in three files, one per batch, after all ticks
    both = ST.Bounded(ST.tick_stream(spark, d)), ST.Bounded(ST.folder_stream(spark, _in_files(x, "funding", _THIRDS), x.schema, 1))
    return ST.run_to_table(ST.stream_asof(both[0].rows, both[1].rows, "rate", delay="1 day"), "asof", closing=both)

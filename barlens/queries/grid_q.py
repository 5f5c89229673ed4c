"""Queries: time axis (TS*) and data quality (DQ*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.operators import quality as Q, timegrid as T
from barlens.queries.registry import cte, query
from barlens.session import scratch_path
from barlens.sources import files as IO, footers as FT, tables as S

BAR = "symbol ts@ open#2 high#2 low#2 close#2 volume#2"


@query("TS1_ticks_to_bars", BAR + " trade_count! quote_volume#2 taker_buy_volume#2", "SELECT * FROM bars_4h")
def _(spark, d):
    return T.ticks_to_bars(S.ticks(spark, d), "4 hours")


@query("TS2_resample_bars", BAR, """
SELECT symbol, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars_1h GROUP BY 1, 2""")
def _(spark, d):
    return T.resample_bars(S.bars(spark, d, "1 hour"), "4 hours")


cte("k4", """SELECT symbol, rn // 4 AS block, min(ts) AS ts, max(ts) AS ts_last, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
       arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_bars FROM b1 GROUP BY 1, 2""")


@query("TS3_resample_by_count", BAR + " block! n_bars!", "SELECT * FROM k4")
def _(spark, d):
    return T.resample_bars_by_count(S.bars(spark, d, "1 hour"), 4)


cte("funding_1h", """
SELECT symbol, unnest(generate_series(ts, coalesce(lead(ts) OVER (PARTITION BY symbol ORDER BY ts) - INTERVAL '1 hour', ts), INTERVAL '1 hour')) AS ts, rate
FROM funding""")


@query("TS4_ffill_resample", "symbol ts@ rate#9", """
SELECT g.symbol, g.ts, f.rate FROM (
  SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM funding GROUP BY symbol) g
ASOF JOIN funding f ON g.symbol = f.symbol AND g.ts >= f.ts""")
def _(spark, d):
    return T.ffill_resample(S.funding(spark, d), "1 hour")


cte("panel", "SELECT t.ts, s.symbol, b.* EXCLUDE (symbol, ts) FROM (SELECT DISTINCT ts FROM bars_4h) t CROSS JOIN (SELECT DISTINCT symbol FROM bars_4h) s LEFT JOIN bars_4h b ON b.ts = t.ts AND b.symbol = s.symbol")
cte("pn", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM panel")


@query("TS5_align_union", "symbol ts@ close#2 volume#2", "SELECT * FROM panel")
def _(spark, d):
    return T.align_union(S.bars(spark, d))


@query("TS6_align_intersection", "symbol ts@ close#2", """
SELECT * FROM bars_4h WHERE ts IN (SELECT ts FROM bars_4h GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars_4h))""")
def _(spark, d):
    return T.align_intersection(S.bars(spark, d))


@query("TS7_reindex_overlay", "symbol ts@ close#2 funding_rate#9", """
SELECT b.symbol, b.ts, b.close, f.rate AS funding_rate FROM bars_4h b LEFT JOIN funding_1h f ON f.symbol = b.symbol AND f.ts = b.ts""")
def _(spark, d):
    f = T.ffill_resample(S.funding(spark, d), "1 hour")
    return T.reindex_overlay(S.bars(spark, d), f, "rate", "funding_rate")


@query("TS8_bucket_last", "symbol ts@ price#2", """
SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1, 2""")
def _(spark, d):
    return T.bucket_last(S.ticks(spark, d), "1 hour", "price", "event_id")


@query("TS9_resample_daily", "symbol day@ close#2", """
SELECT symbol, date_trunc('day', ts) AS day, arg_max(close, ts) AS close FROM bars_1h GROUP BY 1, 2""")
def _(spark, d):
    return T.resample_daily(S.bars(spark, d, "1 hour"))


@query("TS10_stretch_context", "symbol ts@ close#2 ctx_close#2", """
SELECT b.symbol, b.ts, b.close, k.close AS ctx_close FROM (
  SELECT *, CASE WHEN rn = max(rn) OVER (PARTITION BY symbol) THEN rn // 4 ELSE (rn + 1) // 4 - 1 END AS kb FROM b1) b
LEFT JOIN k4 k ON k.symbol = b.symbol AND k.block = b.kb""")
def _(spark, d):
    b = S.bars(spark, d, "1 hour")
    ctx = T.resample_bars_by_count(b, 4).select("symbol", "block", F.col("close").alias("ctx_close"))
    return T.stretch_context(b, ctx, 4, ["ctx_close"])


@query("TS11_normalize_ts", "event_id! a@ b@ c@ e@", """
SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) AS b, date_trunc('second', ts) AS c, date_trunc('second', ts) AS e FROM events""")
def _(spark, d):
    e = S.load(spark, d, "events")
    return e.select("event_id", T.normalize_ts(F.unix_seconds("ts")).alias("a"), T.normalize_ts(F.unix_millis("ts")).alias("b"),
                    T.normalize_ts(F.unix_micros("ts") * 1000).alias("c"),
                    T.normalize_ts(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("e"))


_MIN = "1m 3m 5m 15m 30m 1h 2h 4h 6h 8h 12h 1d 3d 1w".split()


@query("TS12_interval_minutes", "interval minutes! back higher n!", """
SELECT interval, CASE interval WHEN '1h' THEN 60 ELSE 240 END AS minutes, interval AS back,
       CASE interval WHEN '1h' THEN '4h' ELSE '1d' END AS higher, count(*) AS n FROM trades GROUP BY interval""")
def _(spark, d):
    t = S.trades(spark, d).groupBy("interval").agg(F.count(F.lit(1)).alias("n"))
    t = t.withColumn("minutes", T.interval_minutes("interval"))
    return t.withColumns({"back": T.minutes_interval("minutes"), "higher": T.higher_interval("interval")})


QUERY_TS13 = query("TS13_higher_interval", "interval higher n!", """
SELECT interval, CASE interval WHEN '1h' THEN '4h' ELSE '1d' END AS higher, count(*) AS n FROM trades GROUP BY interval""")(
    lambda spark, d: S.trades(spark, d).groupBy("interval").agg(F.count(F.lit(1)).alias("n"))
    .withColumn("higher", T.higher_interval("interval")))


@query("DQ1_detect_gaps", "symbol expected@ actual@", """
SELECT symbol, p + INTERVAL '1 hour' AS expected, ts AS actual FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars_1h)
WHERE ts <> p + INTERVAL '1 hour'""")
def _(spark, d):
    return Q.detect_gaps(S.bars(spark, d, "1 hour"), 60)


# ticks put on a 10-minute grid repeat (symbol, ts) and so serve as dirty data
cte("coarse", "SELECT *  REPLACE (time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS ts) FROM ticks")


def _coarse(spark, d):
    return S.ticks(spark, d).withColumn("ts", S.bucket("ts", "10 minutes"))


@query("DQ2_detect_duplicates", "symbol ts@ event_id!", """
SELECT symbol, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) AS copy FROM coarse) WHERE copy > 1""")
def _(spark, d):
    return Q.detect_duplicates(_coarse(spark, d), ["symbol", "ts"], ["event_id"])


@query("DQ3_quality_report", "symbol first_ts@ last_ts@ received! duplicates! gaps! expected! is_complete?", """
SELECT *, gaps = 0 AND received = expected AS is_complete FROM (
SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, sum(n) AS received, sum(n - 1) AS duplicates,
       count(CASE WHEN ts <> p + INTERVAL '10 minutes' THEN 1 END) AS gaps, (epoch(max(ts)) - epoch(min(ts))) // 600 + 1 AS expected
FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM (SELECT symbol, ts, count(*) AS n FROM coarse GROUP BY 1, 2)) GROUP BY symbol)""")
def _(spark, d):
    return Q.quality_report(_coarse(spark, d), 10)


@query("DQ4_dataset_audit", "side rows! symbols! duplicates! negative_rows! missing_ratio# duplicate_ratio# zero_volume_ratio# status", """
SELECT side, rows, symbols, duplicates, 0 AS negative_rows, 0.0 AS missing_ratio, duplicates / rows AS duplicate_ratio, 0.0 AS zero_volume_ratio,
       CASE WHEN rows < 100 THEN 'TOO_SHORT' WHEN duplicates / rows > 0.05 THEN 'LARGE_GAPS' WHEN duplicates > 0 THEN 'MINOR_GAPS' ELSE 'OK' END AS status
FROM (SELECT side, sum(n)::DOUBLE AS rows, count(DISTINCT symbol) AS symbols, sum(n - 1)::DOUBLE AS duplicates
      FROM (SELECT side, symbol, ts, count(*) AS n FROM coarse GROUP BY 1, 2, 3) GROUP BY side)""")
def _(spark, d):
    p = F.col("price")
    x = _coarse(spark, d).select("symbol", "ts", "side", p.alias("open"), p.alias("high"), p.alias("low"),
                                 p.alias("close"), F.col("size").alias("volume"))
    return Q.dataset_audit(x, ["side"])


@query("DQ5_bar_sanity", "symbol bars! gaps! bad_price! negative_volume! bad_range! extreme_moves! zero_volume! duplicates!", """
SELECT symbol, count(*) AS bars, count(CASE WHEN epoch(ts) - epoch(p) > 1.5 * 14400 THEN 1 END) AS gaps,
       count(CASE WHEN least(open, high, low, close) <= 0 THEN 1 END) AS bad_price, count(CASE WHEN volume < 0 THEN 1 END) AS negative_volume,
       count(CASE WHEN high < low THEN 1 END) AS bad_range, count(CASE WHEN abs(close / pc - 1) > 0.5 THEN 1 END) AS extreme_moves,
       count(CASE WHEN volume = 0 THEN 1 END) AS zero_volume, 0 AS duplicates
FROM (SELECT *, lag(ts) OVER w AS p, lag(close) OVER w AS pc FROM bars_4h WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY symbol""")
def _(spark, d):
    return Q.bar_sanity(S.bars(spark, d), 240)


@query("DQ6_file_integrity", "symbol rows! duplicates! expected_rows!", """
SELECT symbol, sum(n) AS rows, sum(n - 1) AS duplicates, (epoch(max(ts)) - epoch(min(ts))) // 600 + 1 AS expected_rows
FROM (SELECT symbol, ts, count(*) AS n FROM coarse GROUP BY 1, 2) GROUP BY symbol""")
def _(spark, d):
    e = S.load(spark, d, "events").withColumn("file", F.input_file_name())
    return Q.file_integrity(_coarse(spark, d), 10)


@query("DQ6_footer_integrity", "symbol rows! expected_rows! first_ts@ last_ts@ state", """
SELECT *, CASE WHEN rows > expected_rows THEN 'more' WHEN rows < expected_rows THEN 'fewer' ELSE 'full' END AS state FROM (
SELECT symbol, count(*) AS rows, (epoch(max(ts)) - epoch(min(ts))) // 14400 + 1 AS expected_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars_4h GROUP BY symbol, date_trunc('month', ts))""")
def _(spark, d):
    path = scratch_path(spark, "by-symbol")
    IO.write_by_symbol(S.bars(spark, d), path)
    return FT.footer_integrity(FT.footers(spark, path), 240).withColumn("symbol", F.col("partition")["symbol"])


@query("DQ7_content_fingerprint", "symbol first_ts@ last_ts@ rows! content_hash")
def _(spark, d):
    return Q.content_fingerprint(S.bars(spark, d), ["symbol"], ["ts", "open", "high", "low", "close", "volume"])


@query("DQ8_coverage", "symbol cov_funding_rate# cov_oi#", """
SELECT b.symbol, avg(CASE WHEN f.rate IS NOT NULL THEN 1.0 ELSE 0.0 END) AS "cov_funding_rate", avg(CASE WHEN o.value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS cov_oi
FROM bars_1h b LEFT JOIN funding f ON f.symbol = b.symbol AND f.ts = b.ts LEFT JOIN oi o ON o.symbol = b.symbol AND o.ts = b.ts GROUP BY b.symbol""")
def _(spark, d):
    b = T.reindex_overlay(S.bars(spark, d, "1 hour"), S.funding(spark, d), "rate", "funding_rate")
    b = T.reindex_overlay(b, S.open_interest(spark, d), "value", "oi")
    return Q.coverage(b, ["funding_rate", "oi"])


@query("DQ9_missing_ranges", "symbol day@", """
SELECT symbol, day FROM (SELECT symbol, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL '1 day')) AS day FROM bars_1d_orders GROUP BY symbol)
EXCEPT SELECT symbol, ts FROM bars_1d_orders""")
def _(spark, d):
    b = S.bars_1d_orders(spark, d)
    want = b.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z")) \
        .select("symbol", F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("day"))
    return Q.missing_ranges(want, b.select("symbol", F.col("ts").alias("day")), ["symbol", "day"])


cte("cat4", "SELECT symbol, strftime(ts, '%Y-%m') AS month, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS rows FROM bars_1d_orders GROUP BY 1, 2")


@query("DQ10_catalog", "symbol month start_ts@ end_ts@ rows!", "SELECT * FROM cat4")
def _(spark, d):
    return Q.catalog(S.bars_1d_orders(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM")), ["symbol", "month"])


@query("DQ10_footer_catalog", "symbol month start_ts@ end_ts@ rows!", "SELECT * FROM cat4")
def _(spark, d):
    path = scratch_path(spark, "by-symbol")
    IO.write_by_symbol(S.bars_1d_orders(spark, d), path)
    return FT.footer_catalog(FT.footers(spark, path), ["symbol", "month"])


@query("DQ10_catalog_query", "symbol month start_ts@ end_ts@ rows!", """
SELECT * FROM cat4 WHERE start_ts <= TIMESTAMP '1997-03-15' AND end_ts >= TIMESTAMP '1996-11-10'""")
def _(spark, d):
    cat = Q.catalog(S.bars_1d_orders(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM")), ["symbol", "month"])
    return Q.catalog_query(cat, "1996-11-10", "1997-03-15")

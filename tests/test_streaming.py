"""Streams replayed in several batches equal their batch result."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barlens.session import scratch_path
from barlens.sources import tables as S
from barlens.streaming import streams as ST


def sequential(close, threshold, stay=0.85, factor=2.0, size=20):
    """The rules of the online detectors, bar by bar."""
    up = down = odds = 0.0
    low = high = None
    sizes, out = [], []
    for i, (a, b) in enumerate(zip([None, *close], close)):
        row = [np.nan] * 6
        if a is not None:
            r = np.log(b / a)
            sizes.append(abs(r))
            up, down = max(0.0, up + r), max(0.0, down - r)
            row[2] = float(up > threshold or down > threshold)
            up, down = (0.0 if up > threshold else up), (0.0 if down > threshold else down)
            row[:2] = [up, down]
            if i + 1 >= size + 2:
                fresh = low is None
                if fresh:
                    low, q3 = np.percentile(sizes[:size], [25, 75])
                    high = max(1.5 * q3, factor * low)
                lr = np.log(low / high) + r * r / 2 * (1 / low ** 2 - 1 / high ** 2)
                p = 1 / (1 + np.exp(-odds))
                odds = lr + np.log(stay * p + (1 - stay) * (1 - p)) - np.log((1 - stay) * p + stay * (1 - p))
                if odds > 0:
                    high = np.sqrt(stay * high ** 2 + (1 - stay) * r * r)
                else:
                    low = np.sqrt(stay * low ** 2 + (1 - stay) * r * r)
                high = high if high > low else low * factor
                t = np.percentile(sizes[:size] if fresh else sizes[-size:], [33, 67])
                row[3:] = [float(odds > 0), 1 / (1 + np.exp(-odds)), 0.0 if abs(r) <= t[0] else 2.0 if abs(r) >= t[1] else 1.0]
        out.append(row)
    return np.array(out)


def test_online_regime_by_pieces():
    rng = np.random.default_rng(3)
    close = np.exp(np.cumsum(rng.normal(size=2500) * np.repeat(rng.choice([0.01, 0.05], 50), 50)))
    want = sequential(close, 0.15)
    for piece in (2500, 7, 211):
        scan, state, got = ST.OnlineRegime(threshold=0.15), None, []
        for i in range(0, len(close), piece):
            part = pd.DataFrame({"symbol": "s", "ts": 0, "close": close[i:i + piece]})
            out, state = scan(part, state)
            got.append(out.iloc[:, 2:].to_numpy(float))
        assert np.allclose(np.concatenate(got), want, rtol=1e-8, atol=1e-9, equal_nan=True), piece


def _files(df, name, spans, time="ts"):
    path = scratch_path(df.sparkSession, name)
    for lo, hi in spans:
        df.filter((F.col(time) >= lo) & (F.col(time) < hi)).coalesce(1).write.mode("append").parquet(path)
    return path


def test_online_regime_gives_all_rows(spark, bars):
    """The middle comes last: within the delay the order of arrival does not matter; closing the input gives the newest rows too."""
    x = bars.select("symbol", "ts", "close")
    path = _files(x, "bars", (("2024-01-01", "2024-01-11"), ("2024-01-14", "2024-02-01"), ("2024-01-11", "2024-01-14")))
    b = ST.Bounded(ST.folder_stream(spark, path, x.schema, 1))
    got = ST.run_to_table(ST.online_regime(b.rows, delay="20 days", threshold=1.5), "regime", closing=[b]).toPandas()
    rows = x.toPandas().sort_values("ts")
    assert len(got) == len(rows) > 0
    for s, g in rows.groupby("symbol"):
        mine = got[got.symbol == s].sort_values("ts").iloc[:, 2:].to_numpy(float)
        assert np.allclose(mine, sequential(g.close.to_numpy(), 1.5), rtol=1e-8, atol=1e-9, equal_nan=True)


def test_circuit_gives_all_trades_whatever_the_bucket(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"mode": rng.choice(["A", "B"], 400), "closed_at": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 60 * 24, 400)), unit="h"),
                        "order_id": [f"{i:04d}" for i in range(400)], "realized_r": rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    path = _files(df, "trades", (("2024-01-01", "2024-01-20"), ("2024-02-10", "2025-01-01"), ("2024-01-20", "2024-02-10")), "closed_at")
    for bucket in ("1 hour", "1 day", "30 days"):
        b = ST.Bounded(ST.folder_stream(spark, path, df.schema, 1), "closed_at")
        got = ST.run_to_table(ST.rolling_circuit_state(b.rows, n=7, delay="60 days", bucket=bucket), "circuit", closing=[b]).toPandas().set_index("order_id")
        assert len(got) == 400
        for _, g in pdf.sort_values(["closed_at", "order_id"]).groupby("mode"):
            lost = (g.realized_r <= 0).astype(float)
            want = lost.rolling(7, min_periods=1).mean() * 100
            assert np.allclose(got.loc[g.order_id, "failure_rate"], want)
            assert (got.loc[g.order_id, "analyzed"] == np.minimum(np.arange(len(g)) + 1, 7)).all()


def test_late_overlay_and_one_file_a_trigger(spark):
    """The overlay lags behind the base by files; all base rows come out with the value at or before them."""
    base = spark.createDataFrame([("x", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:30:00", i) for i in range(120)], "symbol string, t string, event_id long") \
        .select("symbol", F.to_timestamp("t").alias("ts"), "event_id")
    over = spark.createDataFrame([("x", f"2024-01-{1 + i:02d} 00:00:00", float(i)) for i in range(1, 5)], "symbol string, t string, v double") \
        .select("symbol", F.to_timestamp("t").alias("ts"), "v")
    days = [(f"2024-01-{d:02d}", f"2024-01-{d + 1:02d}") for d in range(1, 6)]
    sides = ST.Bounded(ST.folder_stream(spark, _files(base, "base", days), base.schema, 1)), ST.Bounded(ST.folder_stream(spark, _files(over, "over", days[2:]), over.schema, 1))
    got = ST.run_to_table(ST.stream_asof(sides[0].rows, sides[1].rows, "v", delay="1 hour"), "asof", closing=sides).toPandas().set_index("event_id")
    assert len(got) == 120
    known = got.rate.dropna()
    assert all(got.rate.isna().loc[i] == (i < 48) for i in range(120)) and all(v == i // 24 for i, v in known.items())


def test_a_silent_symbol_goes_stale_once_and_returns(spark):
    hours = [("A", h) for h in range(60)] + [("B", h) for h in [0, 1, 2, 40, 41]]
    df = spark.createDataFrame(hours, "symbol string, h int").select("symbol", F.timestamp_add("HOUR", F.col("h"), F.lit("2024-01-01").cast("timestamp")).alias("ts"))
    path = _files(df, "quiet", [(f"2024-01-0{1 + i // 2} {12 * (i % 2):02d}:00:00", f"2024-01-0{1 + (i + 1) // 2} {12 * ((i + 1) % 2):02d}:00:00") for i in range(5)])
    b = ST.Bounded(ST.folder_stream(spark, path, df.schema, 1))

    def seen(closing):
        out = ST.run_to_table(ST.staleness_events(b.rows, "5 hours", bucket="1 hour"), "stale", closing=closing).toPandas().sort_values(["symbol", "ts"])
        at = ((out.ts - pd.Timestamp("2024-01-01")).dt.total_seconds() / 3600).astype(int)
        return list(zip(out.symbol, at, out.status))

    # still open: the rows of A alone have told that B is silent
    assert seen([]) == [("A", 0, "FRESH"), ("B", 0, "FRESH"), ("B", 7, "STALE"), ("B", 40, "FRESH"), ("B", 46, "STALE")]
    assert seen([b]) == [("A", 0, "FRESH"), ("A", 64, "STALE"), ("B", 0, "FRESH"), ("B", 7, "STALE"), ("B", 40, "FRESH"), ("B", 46, "STALE")]


def test_stream_bars_equal_batch(spark, sf):
    got = ST.run_to_table(ST.stream_bars(ST.tick_stream(spark, sf), "4 hours", "1 hour"), "b")
    want = S.bars(spark, sf).select(*got.columns)
    assert got.count() > 0 and got.exceptAll(want).count() == 0
    b = ST.Bounded(ST.tick_stream(spark, sf))
    whole = ST.run_to_table(ST.stream_bars(b.rows, "4 hours", "1 hour"), "b", closing=[b])
    assert whole.count() == want.count() and whole.exceptAll(want).count() == 0


def test_upsert_keeps_latest(spark, sf):
    got = ST.stream_upsert(ST.tick_stream(spark, sf), "u", ["symbol"], ["ts", "event_id"]).toPandas()
    t = S.ticks(spark, sf).toPandas().sort_values(["ts", "event_id"]).groupby("symbol").tail(1)
    assert set(zip(got.symbol, got.event_id)) == set(zip(t.symbol, t.event_id))

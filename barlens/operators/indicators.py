"""The indicator set of the trading runtime (W46), its latest row (W54), swing levels (W59), mode sets (W56)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions import bars as B
from barlens.functions.core import div, ieee_div
from barlens.operators import features as ft, flow as fl
from barlens.operators.windows import RN, lag, r_kurt, r_list, r_max, r_mean, r_min, r_skew, r_std, r_sum, w_slope
from barlens.plans.ordered import blocked, core_rows, frame
from barlens.plans.recurrence import Ema, emas, lookback_for

LOOKBACK = lookback_for(2.0 / 201) + 40


def _m(x, n):
    return r_mean(x, n, 1, full=False)


def runtime_indicators(bars: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """Windows start partial; undefined values take their neutral value.

    Needs open, high, low, close, volume, and uses trade_count, quote_volume and
    taker_buy_volume where present.
    """
    src = ft.prefix_columns(bars, rows_per_block).drop("vwap_deviation", "consecutive_up_N", "consecutive_dn_N")
    b = blocked(src, LOOKBACK, 14, rows_per_block=rows_per_block)
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    pc = lag("close")
    tp = B.typical_price()
    up, dn = h - lag("high"), lag("low") - lo
    b = b.withColumns({
        "_d": c - pc, "_tp": tp, "_tr": F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)),
        "_pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0), "_mdm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
        "log_return": F.coalesce(F.when((c > 0) & (pc > 0), F.log(div(c, pc))), F.lit(0.0))})
    d = F.col("_d")
    b = b.withColumns({"_g": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_l": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    b = emas(b, *[Ema("close", 2.0 / (n + 1), f"ema_{n}") for n in (9, 12, 13, 21, 26, 50, 200)],
             *[Ema(x, 1.0 / 14, f"{x}w", min_periods=mp) for x, mp in (("_g", 14), ("_l", 14), ("_tr", 14), ("_pdm", 1), ("_mdm", 1))])
    # the warm-up takes the first known ATR
    first_atr = F.max(F.when(RN() == 13, F.col("_trw"))).over(frame(start=0, end=13))
    b = b.withColumn("atr", F.coalesce("_trw", first_atr))
    b = b.withColumn("rsi", F.coalesce(100.0 - 100.0 / (1.0 + div("_gw", "_lw")), F.lit(50.0)))
    b = b.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    pdi, mdi = F.coalesce(div(100.0 * F.col("_pdmw"), "atr"), F.lit(0.0)), F.coalesce(div(100.0 * F.col("_mdmw"), "atr"), F.lit(0.0))
    b = b.withColumns({"dmp": pdi, "dmn": mdi})
    b = b.withColumn("_dx", F.coalesce(div(F.abs(F.col("dmp") - F.col("dmn")), F.col("dmp") + F.col("dmn")) * 100.0, F.lit(0.0)))
    b = emas(b, Ema("macd", 0.2, "macd_signal"), Ema("_dx", 1.0 / 14, "_adx", min_periods=14))
    b = b.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    hh, ll = r_max(h, 14, 1, full=False), r_min(lo, 14, 1, full=False)
    rmin, rmax = r_min("rsi", 14, 1, full=False), r_max("rsi", 14, 1, full=False)
    sd20 = F.coalesce(r_std(c, 20, 2, full=False), F.lit(0.0))
    prev = F.coalesce(pc, c)
    low_, high_ = F.least(lo, prev), F.greatest(h, prev)
    b = b.withColumns({
        "stoch_k": F.coalesce(div(c - ll, hh - ll) * 100.0, F.lit(50.0)), "willr": F.coalesce(-100.0 * div(hh - c, hh - ll), F.lit(-50.0)),
        "_srsi": F.coalesce(div(F.col("rsi") - rmin, rmax - rmin) * 100.0, F.lit(50.0)), "bb_mid": _m(c, 20), "bb_std": sd20,
        "_bp": c - low_, "_tru": high_ - low_, "_tpl": r_list("_tp", 20), "_tpm": _m("_tp", 20), "vol_ratio": F.coalesce(div(v, _m(v, 20)), F.lit(1.0)),
        "realized_vol_10": F.coalesce(r_std("log_return", 10, 5, full=False), F.lit(0.0)),
        "realized_vol_20": F.coalesce(r_std("log_return", 20, 6, full=False), F.lit(0.0)),
        "realized_vol_50": F.coalesce(r_std("log_return", 50, 20, full=False), F.lit(0.0)),
        "mean_return_10": F.coalesce(r_mean("log_return", 10, 3, full=False), F.lit(0.0)),
        "mean_return_20": F.coalesce(r_mean("log_return", 20, 5, full=False), F.lit(0.0)),
        "return_skew_20": F.coalesce(r_skew("log_return", 20, 8), F.lit(0.0)), "return_kurtosis_20": F.coalesce(r_kurt("log_return", 20, 8), F.lit(0.0)),
        "rsi_slope": F.col("rsi") - lag("rsi", 3), "macd_hist_delta": F.col("macd_hist") - lag("macd_hist"),
        "ao": _m((h + lo) / 2.0, 5) - _m((h + lo) / 2.0, 34), "mom": F.coalesce(c - lag("close", 10), F.lit(0.0)),
        "atr_5bar_avg": _m("atr", 5), "adx": F.coalesce("_adx", F.lit(0.0)),
        "price_vs_ema50": F.coalesce(div(c - F.col("ema_50"), "ema_50") * 100.0, F.lit(0.0)),
        "bbp": h + lo - 2.0 * F.col("ema_13")})

    def s(x, n):
        return r_sum(x, n, 1, full=False)

    uo = 100.0 * (4 * div(s("_bp", 7), s("_tru", 7)) + 2 * div(s("_bp", 14), s("_tru", 14)) + div(s("_bp", 28), s("_tru", 28))) / 7.0
    mad = F.aggregate(F.transform("_tpl", lambda x: F.abs(x - F.col("_tpm"))), F.lit(0.0), lambda a, x: a + x) / F.size("_tpl")
    b = b.withColumns({
        "stoch_d": _m("stoch_k", 3), "stochrsi_k": _m("_srsi", 3), "uo": F.coalesce(uo, F.lit(50.0)), "_mad": mad,
        "bb_upper": F.col("bb_mid") + 2 * F.col("bb_std"), "bb_lower": F.col("bb_mid") - 2 * F.col("bb_std"),
        "bb_width": F.coalesce(div(4 * F.col("bb_std"), "bb_mid") * 100.0, F.lit(0.0)),
        "vol_slope": F.coalesce(F.when(F.count("vol_ratio").over(frame(5)) >= 2, w_slope(F.col("vol_ratio"), RN().cast("double"), frame(5))), F.lit(0.0)),
        "return_zscore": F.coalesce(div("log_return", "realized_vol_20"), F.lit(0.0)),
        "vol_cluster_ratio": F.coalesce(div("realized_vol_10", "realized_vol_50"), F.lit(1.0)),
        "return_trend_ratio": F.coalesce(div("mean_return_20", "realized_vol_20"), F.lit(0.0)),
        "atr_expanding": F.coalesce(F.col("atr") > F.col("atr_5bar_avg"), F.lit(False))})
    b = b.withColumns({"stochrsi_d": _m("stochrsi_k", 3), "cci": F.coalesce(div(F.col("_tp") - F.col("_tpm"), 0.015 * F.col("_mad")), F.lit(0.0))})
    if "taker_buy_volume" in bars.columns:
        t = F.col("taker_buy_volume")
        b = b.withColumns({"buy_volume_share": F.coalesce(F.least(F.greatest(div(t, v), F.lit(0.0)), F.lit(1.0)), F.lit(0.5)),
                           "flow_imbalance": F.coalesce(div(2 * t - v, v), F.lit(0.0))})
        b = b.withColumn("sell_volume_share", 1.0 - F.col("buy_volume_share"))
    if "trade_count" in bars.columns:
        n = F.col("trade_count").cast("double")
        b = b.withColumn("trade_intensity", F.coalesce(div(n, r_mean(n, 20, 3, full=False)), F.lit(1.0)))
        if "quote_volume" in bars.columns:
            b = b.withColumn("avg_trade_notional", F.coalesce(div("quote_volume", n), F.lit(0.0)))
    b = b.withColumnRenamed("obv_N", "obv").withColumn("vwap", F.coalesce("vwap_cum", c)).drop("vwap_cum")
    b = b.withColumns({"obv_slope": F.coalesce(F.col("obv") - lag("obv", 5), F.lit(0.0)),
                       "price_vs_vwap": F.coalesce(div(c - F.col("vwap"), "vwap") * 100.0, F.lit(0.0))})
    return core_rows(b.drop(*[x for x in b.columns if x.startswith("_")]))


def latest_snapshot(features: DataFrame, cols: list[str]) -> DataFrame:
    """Last row per symbol with a volatility label and the session, by one aggregate."""
    g = features.groupBy("symbol").agg(F.max_by(F.struct("ts", *cols), "ts").alias("_r")).select("symbol", "_r.*")
    label, score = B.session_label(F.col("ts"))
    out = {"session_label": label, "session_liquidity": score}
    if "vol_cluster_ratio" in cols:
        r = F.col("vol_cluster_ratio")
        out["volatility_regime"] = F.when(r >= 1.35, "EXPANDING").when(r <= 0.75, "CONTRACTING").otherwise("STABLE")
    return g.withColumns(out)


def _clusters(levels: Column, width: float) -> Column:
    """Means of runs of sorted levels whose neighbours lie within ``width`` (relative)."""
    empty = F.array().cast("array<struct<last:double,sum:double,n:int>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (ieee_div(x - last["last"], last["last"]) < width)
        one = F.struct(x.alias("last"), x.alias("sum"), F.lit(1).alias("n"))
        merged = F.struct(x.alias("last"), (last["sum"] + x).alias("sum"), (last["n"] + 1).alias("n"))
        return F.when(F.size(acc) == 0, F.array(one)).when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))) \
            .otherwise(F.concat(acc, F.array(one)))

    runs = F.aggregate(F.array_sort(F.array_distinct(levels)), empty, add)
    return F.transform(runs, lambda r: r["sum"] / r["n"])


def swing_levels(bars: DataFrame, lookback: int = 50, order: int = 5, width: float = 0.003, near: float = 0.005) -> DataFrame:
    """Support and resistance of the last ``lookback`` bars of each symbol.

    Only the newest bars of a symbol are gathered (a top-n per key), so the
    arrays have at most ``lookback`` entries.  A pivot needs ``order`` later bars.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    last = bars.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= lookback)
    g = last.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "high", "low", "close"))).alias("_a"))
    g = g.withColumns({"_h": F.col("_a.high"), "_l": F.col("_a.low"), "n": F.size("_a"), "ts": F.element_at("_a", -1)["ts"],
                       "price": F.element_at("_a", -1)["close"], "_pc": F.get("_a", F.size("_a") - 2)["close"],
                       "_lh": F.element_at("_a", -1)["high"], "_ll": F.element_at("_a", -1)["low"]})
    span = 2 * order + 1

    def pivots(col, pick):
        inner = F.filter(F.sequence(F.lit(order), F.greatest(F.col("n") - order - 1, F.lit(order))), lambda i: i < F.col("n") - order)
        hit = F.filter(inner, lambda i: F.get(col, i) == pick(F.slice(col, i - order + 1, F.lit(span))))
        return F.transform(hit, lambda i: F.get(col, i))

    enough = F.col("n") >= max(lookback // 2, span)
    g = g.withColumns({"_ph": F.when(enough, pivots(F.col("_h"), F.array_max)), "_pl": F.when(enough, pivots(F.col("_l"), F.array_min))})
    g = g.withColumns({"_ch": _clusters(F.col("_ph"), width), "_cl": _clusters(F.col("_pl"), width)})
    p, pc = F.col("price"), F.col("_pc")
    g = g.withColumns({"resistance": F.array_min(F.filter("_ch", lambda x: x > p)), "support": F.array_max(F.filter("_cl", lambda x: x < p)),
                       "breakout_up": F.coalesce(F.exists("_ch", lambda x: (pc < x) & (x <= p)), F.lit(False)),
                       "breakout_down": F.coalesce(F.exists("_cl", lambda x: (pc > x) & (x >= p)), F.lit(False))})
    r, s, no = F.col("resistance"), F.col("support"), F.lit(False)
    g = g.withColumns({"near_resistance": F.coalesce(ieee_div(r - p, p) < near, no), "near_support": F.coalesce(ieee_div(p - s, p) < near, no),
                       "bullish_sweep": F.coalesce((F.col("_ll") < s) & (p > s), no), "bearish_sweep": F.coalesce((F.col("_lh") > r) & (p < r), no)})
    g = g.withColumns({"retest_support": F.col("breakout_up") & F.col("near_support"), "retest_resist": F.col("breakout_down") & F.col("near_resistance")})
    return g.drop("_a", "_h", "_l", "_pc", "_lh", "_ll", "_ph", "_pl", "_ch", "_cl")


# fixed values: window sizes per trading mode
MODES = {
    "SWING": dict(n_returns=10, vol=20, atr=14, mom=10, rsi=14, macd=(12, 26, 9), volume=20, breakout=20, bb=20, vol_regime=20, candle=10,
                  roll=20, noise=30, serial=20, vpin=30, impact=20, micro=5, vacuum=10, depth=5, ofi=10, per_year=2190),
    "SCALP": dict(n_returns=12, vol=24, atr=14, mom=12, rsi=14, macd=(8, 17, 9), volume=24, breakout=24, bb=20, vol_regime=15, candle=12,
                  roll=12, noise=20, serial=12, vpin=40, impact=12, micro=8, vacuum=10, depth=8, ofi=10, per_year=8760),
    "AGGRESSIVE_SCALP": dict(n_returns=16, vol=24, atr=10, mom=16, rsi=10, macd=(6, 13, 5), volume=24, breakout=12, bb=12, vol_regime=10, candle=16,
                             roll=10, noise=20, serial=10, vpin=50, impact=15, micro=5, vacuum=10, depth=5, ofi=10, per_year=35040),
}


def feature_set(bars: DataFrame, mode: str = "SWING", groups: list[str] | None = None, rows_per_block: int | None = None) -> DataFrame:
    """All feature groups of a mode in one layout; ``groups`` selects some of them."""
    p = MODES[mode]
    fast, slow, sig = p["macd"]
    every = {
        "returns": lambda x: ft.returns_group(x, p["n_returns"], p["vol"]), "volatility": lambda x: ft.volatility_group(x, p["vol"]),
        "atr": lambda x: ft.atr_group(x, p["atr"]), "momentum": lambda x: ft.momentum_group(x, p["mom"], p["rsi"], fast, slow, sig),
        "volume": lambda x: ft.volume_ratio_group(x, p["volume"]),
        "breakout": lambda x: ft.range_breakout(ft.bollinger(x, p["bb"]), p["breakout"]), "trend": ft.trend_group,
        "orderbook": lambda x: fl.orderbook_group(ft.base(x), roll_n=p["roll"], noise_n=p["noise"], serial_n=p["serial"], vpin_n=p["vpin"],
                                                  impact_n=p["impact"], micro_n=p["micro"], vacuum_n=p["vacuum"], depth_n=p["depth"], ofi_n=p["ofi"]),
        "candle": lambda x: ft.candle_group(x, p["candle"]), "regime": lambda x: ft.volatility_regime(x, p["vol_regime"]),
        "scalp_momentum": ft.scalp_momentum_group, "taker_flow": ft.taker_flow_group,
        "time": lambda x: x.withColumns(B.calendar(F.col("ts"))),
    }
    prefix = {"cumulative": ["vwap_cum", "vwap_deviation", "obv_N"], "streaks": ["consecutive_up_N", "consecutive_dn_N"]}
    pick = groups or [*every, *prefix]
    look = max(302, ft.momentum_lookback(p["rsi"], fast, slow, sig) if "momentum" in pick else 0)
    unused = [x for g, xs in prefix.items() if g not in pick for x in xs]
    src = ft.prefix_columns(bars, rows_per_block).drop(*unused) if any(g in pick for g in prefix) else bars
    df = ft.base(blocked(src, look, rows_per_block=rows_per_block))
    for name in every:
        if name in pick:
            df = every[name](df)
    return core_rows(df).drop("ret", "tr", "up_vol", "dn_vol", "obi_")


__all__ = [k for k in list(globals()) if not k.startswith("_")]

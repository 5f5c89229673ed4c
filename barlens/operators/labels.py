"""Barrier and return labels from forward paths (L1..L7, L13..L17)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barlens.functions import trading as P
from barlens.functions.core import c, div
from barlens.operators.windows import lag, lead, r_mean
from barlens.plans.first_touch import Excursion, Touch, ahead
from barlens.plans.ordered import blocked, core_rows, frame


def with_path(df: DataFrame, h: int) -> DataFrame:
    """Arrays of the next ``h`` highs, lows and closes (blocked table, lookahead >= h)."""
    w = frame(start=1, end=h)
    return df.withColumns({k: F.collect_list(s).over(w) for k, s in (("_hi", "high"), ("_lo", "low"), ("_cl", "close"))})


def _first_hit(arr: Column, level: Column, at_or_below: bool) -> Column:
    """1-based position of the first element that reaches the level, NULL without one."""
    p = F.array_position(F.transform(arr, (lambda x: x <= level) if at_or_below else (lambda x: x >= level)), F.lit(True))
    return F.when(p > 0, p.cast("int"))


def barrier_exit(df: DataFrame, out: str, side: str, entry: str, stop: str, target: str, risk: str, *,
                 liquidation: str | None = None, mae_mode: str = "adverse", hi="_hi", lo="_lo", cl="_cl") -> DataFrame:
    """Add struct ``out``: the first barrier hit on the path of each row.

    The stop wins when both lie in one bar; without a hit the last close counts.
    Excursions cover the bars before a stop, target or liquidation bar, and the
    whole path for a time exit.  mae_mode 'reference' measures a short's adverse
    move on the low side of the highs; 'adverse' on the side that loses.
    The array work is done once per column, in steps, so that no expression
    repeats it.
    """
    long = side == "LONG"
    e, st, tg, rk = c(entry), c(stop), c(target), c(risk)
    down, up = (lo, hi) if long else (hi, lo)  # arrays that reach the stop and the target side
    t = f"_{out}"
    n = F.size(hi)
    df = df.withColumns({
        f"{t}_s": _first_hit(c(down), st, long), f"{t}_t": _first_hit(c(up), tg, not long),
        f"{t}_q": _first_hit(c(down), c(liquidation), long) if liquidation is not None else F.lit(None).cast("int")})
    s, g, q = (F.coalesce(f"{t}_{k}", n + 1) for k in "stq")
    df = df.withColumns(_exit(t, long, e, st, tg, c(liquidation) if liquidation is not None else None, n, s, g, q, F.get(c(cl), n - 1)))
    h = F.col(f"{t}_h")
    seen = F.when(F.col(f"{t}_r") == "TIME_EXIT", h).otherwise(h - 1)
    hs, ls = F.slice(c(hi), F.lit(1), seen), F.slice(c(lo), F.lit(1), seen)
    gains = F.transform(hs, lambda x: x - e) if long else F.transform(ls, lambda x: e - x)
    losses = (F.transform(ls, lambda x: x - e) if long else F.transform(hs, lambda x: x - e) if mae_mode == "reference"
              else F.transform(hs, lambda x: e - x))
    df = df.withColumns({f"{t}_g": gains, f"{t}_l": losses})
    df = df.withColumns({f"{t}_mx": F.array_max(f"{t}_g"), f"{t}_mn": F.array_min(f"{t}_l")})
    mx, mn = F.col(f"{t}_mx"), F.col(f"{t}_mn")
    df = df.withColumn(out, _outcome(t, long, e, rk, mx, F.array_position(F.col(f"{t}_g"), mx) - 1, mn, F.array_position(F.col(f"{t}_l"), mn) - 1))
    return df.drop(*[f"{t}_{k}" for k in ("s", "t", "q", "r", "p", "h", "b", "g", "l", "mx", "mn")])


def _exit(t: str, long: bool, e: Column, st: Column, tg: Column, liq: Column | None, n: Column, s: Column, g: Column, q: Column, last: Column) -> dict[str, Column]:
    """Reason, price, bars held and whether both barriers lie in one bar, from the bars to each barrier (n + 1: not reached)."""
    is_liq = (q <= n) & (q <= s)
    is_stop = ~is_liq & (s <= n) & (s <= g)
    is_tgt = ~is_liq & ~is_stop & (g <= n)
    reason = F.when(is_liq, "LIQUIDATED").when(is_stop, "STOP_HIT").when(is_tgt, "TARGET_HIT").otherwise("TIME_EXIT")
    price = F.when(n == 0, e).when(is_liq, F.lit(None).cast("double") if liq is None else liq).when(is_stop, st).when(is_tgt, tg).otherwise(last)
    held = F.when(n == 0, 0).when(is_liq, q).when(is_stop, s).when(is_tgt, g).otherwise(n)
    return {f"{t}_r": reason, f"{t}_p": price, f"{t}_h": held, f"{t}_b": (s == g) & (s <= n)}


def _outcome(t: str, long: bool, e: Column, rk: Column, best: Column, best_at: Column, worst: Column, worst_at: Column) -> Column:
    r, h, p, zero = F.when(rk > 0, rk), F.col(f"{t}_h"), F.col(f"{t}_p"), F.lit(0.0)
    mfe, mae = F.coalesce(best, zero), F.when(worst < 0, worst).otherwise(0.0)
    return F.struct(
        F.col(f"{t}_r").alias("exit_reason"), p.alias("exit_price"), F.greatest(h - 1, F.lit(0)).alias("exit_bar_index"),
        h.alias("hold_bars"), F.coalesce(div((p - e) if long else (e - p), r), zero).alias("gross_r"),
        mfe.alias("mfe"), mae.alias("mae"), F.coalesce(div(mfe, r), zero).alias("mfe_r"), F.coalesce(div(mae, r), zero).alias("mae_r"),
        F.coalesce(best_at, F.lit(0)).cast("int").alias("time_to_mfe"), F.when(worst < 0, worst_at).otherwise(0).cast("int").alias("time_to_mae"),
        F.col(f"{t}_b").alias("same_bar"))


@dataclass(frozen=True)
class Barrier:
    """One side of a trade: columns of its stop and target (and liquidation) levels."""

    out: str
    side: str
    stop: str
    target: str
    liquidation: str | None = None


def barrier_exits(df: DataFrame, h: int, barriers: list[Barrier], entry: str, risk: str, mae_mode: str = "adverse") -> DataFrame:
    """:func:`barrier_exit` for the core rows of a blocked table (lookahead >= h), the next ``h`` bars read from sparse tables.

    No row carries its path, so a long horizon costs little more than a short one.
    """
    touches, excursions = [], []
    for b in barriers:
        t, long = f"_{b.out}", b.side == "LONG"
        down, up = ("low", "high") if long else ("high", "low")
        mine = [Touch(f"{t}_s", b.stop, down, not long), Touch(f"{t}_t", b.target, up, long)]
        if b.liquidation:
            mine.append(Touch(f"{t}_q", b.liquidation, down, not long))
        worst = (down, not long) if long or mae_mode == "adverse" else ("high", False)
        touches += mine
        excursions.append(Excursion(t, tuple(x.out for x in mine), (up, long), worst))
    df = ahead(df, h, touches, excursions).withColumn("_n", F.col("_n").cast("int"))
    e, rk, n = c(entry), c(risk), F.col("_n")
    for b in barriers:
        t, long = f"_{b.out}", b.side == "LONG"
        s, g, q = (F.coalesce(F.col(f"{t}_{k}").cast("int"), n + 1) if k != "q" or b.liquidation else n + 1 for k in "stq")
        df = df.withColumns(_exit(t, long, e, c(b.stop), c(b.target), c(b.liquidation) if b.liquidation else None, n, s, g, q, F.col("_last")))
        best, worst = F.col(f"{t}_best"), F.col(f"{t}_worst")
        df = df.withColumn(b.out, _outcome(t, long, e, rk, best - e if long else e - best, F.col(f"{t}_best_at"),
                                           worst - e if long or mae_mode == "reference" else e - worst, F.col(f"{t}_worst_at")))
    made = [f"_{b.out}_{k}" for b in barriers for k in ("r", "p", "h", "b", "best", "best_at", "worst", "worst_at")]
    return df.drop("_n", "_last", *made, *[x.out for x in touches])


def trailing_atr(n: int = 15) -> Column:
    """Mean true range of up to n bars including the current one (table with ``tr``)."""
    return F.avg("tr").over(frame(n))


# fixed values: the labelling profile
PROFILE = dict(horizon=12, stop=1.5, target=1.5, margin=0.10, min_edge=0.15, w_mae=2.0, w_cost=2.0, w_time=1.5)


def barrier_label(df: DataFrame, profile: dict | None = None, mae_mode: str = "adverse") -> DataFrame:
    """Both sides of the barrier with costs, utilities, no-trade value and best action.

    ``df`` is blocked (lookback 15, lookahead horizon+1) and has ``tr``.  Rows
    without a full horizon plus one bar are dropped.
    """
    p = {**PROFILE, **(profile or {})}
    h = p["horizon"]
    df = df.withColumns({"entry": F.col("close"), "atr": trailing_atr(15), "_more": F.lead("rn", h + 1).over(frame())})
    lv = P.stop_target_levels("entry", "atr", p["stop"], p["target"])
    df = df.withColumns({**lv, "risk": P.entry_risk("atr", p["stop"])})
    df = barrier_exits(df, h, [Barrier("long", "LONG", "long_stop", "long_target"), Barrier("short", "SHORT", "short_stop", "short_target")], "entry", "risk", mae_mode)
    df = df.filter(F.col("_more").isNotNull()).drop("_more").withColumn("cost_r", P.total_cost_r("entry", "entry", "atr", p["stop"]))
    for s in ("long", "short"):
        df = df.withColumn(f"{s}_net", F.col(f"{s}.gross_r") - F.col("cost_r"))
        df = df.withColumn(f"{s}_utility", P.action_utility(
            F.col(f"{s}_net"), F.col(f"{s}.mae_r"), F.col("cost_r"), F.col(f"{s}.time_to_mfe"),
            p["w_mae"], p["w_cost"], p["w_time"]))
    df = df.withColumns(P.no_trade_outcome("long_net", "short_net", F.lit(p["stop"]), F.lit(p["target"]), p["min_edge"], p["margin"]))
    return df.withColumns(P.best_action("long_utility", "short_utility", "saved_loss_r", "missed_opportunity_r", p["margin"]))


def r_multiple_label(df: DataFrame, stop=2.5, target=2.5, horizon=24, cost=0.0008, min_edge=0.15, margin=0.1,
                     cost_mode: str = "fraction") -> DataFrame:
    """Simplified barrier label: -1, target/stop or the open result in R, minus costs.

    ``cost_mode`` 'fraction' charges cost*entry/risk; 'reference' cost/risk.
    """
    df = df.withColumns({"atr": trailing_atr(15), "_more": F.lead("rn", horizon + 1).over(frame())})
    lv = P.stop_target_levels("close", "atr", stop, target)
    df = df.withColumns({**lv, "risk": P.entry_risk("atr", stop)})
    ok = (F.col("close") > 0) & (F.col("atr") > 0) & (F.col("atr") <= F.col("close") * 0.5)
    df = barrier_exits(df, horizon, [Barrier("_l", "LONG", "long_stop", "long_target"), Barrier("_s", "SHORT", "short_stop", "short_target")], "close", "risk")
    df = df.filter(F.col("_more").isNotNull()).drop("_more")
    k = div(F.lit(cost) * (F.col("close") if cost_mode == "fraction" else F.lit(1.0)), F.col("risk"))
    df = df.withColumns({"_k": k, "_ok": ok})
    df = df.withColumns({"long_r": F.when(F.col("_ok"), F.col("_l.gross_r") - F.col("_k")).otherwise(0.0),
                         "short_r": F.when(F.col("_ok"), F.col("_s.gross_r") - F.col("_k")).otherwise(0.0)})
    a, b = F.col("long_r"), F.col("short_r")
    unsure = ~F.col("_ok") | (F.abs(a - b) <= margin)
    label = F.when(unsure, 2).when((a > b) & (a > min_edge), 0).when((b > a) & (b > min_edge), 1).otherwise(2)
    df = df.withColumn("label", label)
    return df.withColumn("net_r", F.when(label == 0, a).when(label == 1, b).otherwise(0.0)) \
        .drop("_l", "_s", "_k", "_ok")


def forward_return_label(df: DataFrame, horizon=12, threshold=0.003, cost=0.001) -> DataFrame:
    """Sign of the horizon return beyond a threshold (blocked table, lookahead horizon+1)."""
    fwd = div(lead("close", horizon), F.col("close")) - 1.0
    df = df.withColumns({"fwd": fwd, "_more": F.lead("rn", horizon + 1).over(frame())})
    df = df.filter(F.col("core") & F.col("_more").isNotNull()).drop("_more")
    f = F.col("fwd")
    up, dn = F.greatest(f, F.lit(0.0)), F.greatest(-f, F.lit(0.0))
    return df.withColumns({
        "label": F.when(f > threshold, 0).when(f < -threshold, 1).otherwise(2),
        "net_r": F.when(f > threshold, up - cost).when(f < -threshold, dn - cost).otherwise(0.0),
        "long_net": up - cost, "short_net": dn - cost})


# fixed values: leverage tiers, and (notional cap, maintenance margin ratio) brackets
LEVERAGE_TIERS = [1, 2, 3, 5, 7, 10]
BRACKETS = [(50_000, 0.004), (250_000, 0.005), (1_000_000, 0.01)]


def maintenance_ratio(notional) -> Column:
    """Ratio of the smallest bracket that covers the notional, NULL beyond the last."""
    out = F
    for cap, ratio in BRACKETS:
        out = out.when(c(notional) <= cap, ratio)
    return out.otherwise(None)


def leverage_label(df: DataFrame, horizon=12, stop=2.0, target=2.0, min_edge=0.15) -> DataFrame:
    """Barrier outcome per leverage tier with a liquidation barrier, and the best tier.

    The tiers are an array literal on each row: no join.
    """
    df = df.withColumn("_more", F.lead("rn", horizon).over(frame()))
    df = df.withColumn("atr", F.greatest(F.col("high") - F.col("low"), F.lit(10.0)))
    df = df.withColumns({**P.stop_target_levels("close", "atr", stop, target), "risk": P.entry_risk("atr", stop),
                         # an entry at 0 has no size, so no cost and no result: no trade
                         "cost_r": F.when(F.col("close") != 0, P.total_cost_r("close", "close", "atr", stop))})
    # the stop and target bars are shared by all tiers; only the liquidation bar differs
    mmr, n = maintenance_ratio("close"), F.col("_n")
    touches, price = [], {}
    for side in ("LONG", "SHORT"):
        k, long = side[0].lower(), side == "LONG"
        down, up = ("low", "high") if long else ("high", "low")
        touches += [Touch(f"_{k}s", f"{side.lower()}_stop", down, not long), Touch(f"_{k}t", f"{side.lower()}_target", up, long)]
        for lev in LEVERAGE_TIERS[1:]:
            dist = 1.0 / lev - mmr
            price[(side, lev)] = F.col(f"_{k}p{lev}")
            df = df.withColumn(f"_{k}p{lev}", F.when(dist > 0, F.col("close") * (1.0 - dist if long else 1.0 + dist)))
            touches.append(Touch(f"_{k}q{lev}", f"_{k}p{lev}", down, not long))
    df = ahead(df, horizon, touches).filter(F.col("_more").isNotNull()).drop("_more")
    rows = []
    for side in ("LONG", "SHORT"):
        k, sg = side[0].lower(), 1.0 if side == "LONG" else -1.0
        s_, t_ = F.coalesce(f"_{k}s", n + 1), F.coalesce(f"_{k}t", n + 1)
        for lev in LEVERAGE_TIERS:
            liq = F.lit(False) if lev == 1 else F.coalesce((F.col(f"_{k}q{lev}") <= n) & (F.col(f"_{k}q{lev}") <= s_), F.lit(False))
            out = (F.when(liq, price[(side, lev)]) if lev > 1 else F).when((s_ <= n) & (s_ <= t_), F.col(f"{side.lower()}_stop")) \
                .when(t_ <= n, F.col(f"{side.lower()}_target")).otherwise(F.col("_last"))
            net = sg * (out - F.col("close")) / F.col("risk") - F.col("cost_r")
            # result on the posted margin: R * risk * quantity / (notional / leverage), quantity 1
            ret = net if lev == 1 else div(net * F.col("risk") * lev, F.col("close"))
            rows.append(F.struct(F.lit(side).alias("side"), F.lit(lev).alias("leverage"), net.alias("net_r"),
                                 ret.alias("margin_return"), liq.alias("liquidated")))
    df = df.withColumn("tiers", F.array(*rows)).drop("_n", "_last", *[x.out for x in touches], *[f"_{k}p{lev}" for k in "ls" for lev in LEVERAGE_TIERS[1:]])
    best = F.array_max(F.transform(F.filter("tiers", lambda t: t["net_r"] > 0), lambda t: F.struct(
        t["margin_return"].alias("m"), F.when(t["side"] == "LONG", 1).otherwise(0).alias("first"), (-t["leverage"]).alias("l"), t["side"].alias("side"))))

    def one(side):
        return F.get(F.filter("tiers", lambda t: (t["side"] == side) & (t["leverage"] == 1)), F.lit(0))["net_r"]

    df = df.withColumns({"_b": best, "_l1": one("LONG"), "_s1": one("SHORT")})
    go = (F.greatest("_l1", "_s1") > min_edge) & (F.col("_l1") != F.col("_s1"))
    return df.withColumns({
        "direction": F.when(go & (F.col("_l1") > F.col("_s1")), 0).when(go, 1).otherwise(2),
        "best_side": F.when(go, F.coalesce(F.col("_b.side"), F.lit("NO_TRADE"))).otherwise("NO_TRADE"),
        "best_leverage": F.when(go, F.coalesce(-F.col("_b.l"), F.lit(0))).otherwise(0),
        "margin_return": F.when(go, F.coalesce(F.col("_b.m"), F.lit(0.0))).otherwise(0.0),
        "liquidation_rate": F.size(F.filter("tiers", lambda t: t["liquidated"])) / float(len(rows))}).drop("_b", "_l1", "_s1")


def candidate_rows(labelled: DataFrame, id_cols: list[str]) -> DataFrame:
    """LONG and SHORT rows of each outcome with buckets and ids."""
    e = F.explode(F.array(*[F.struct(F.lit(s.upper()).alias("side"), F.col(f"{s}.gross_r").alias("gross_r"),
                                     F.col(f"{s}_net").alias("net_r"), F.col(f"{s}.mfe_r").alias("mfe_r"),
                                     F.col(f"{s}.mae_r").alias("mae_r"), F.col(f"{s}.hold_bars").alias("bars_held"),
                                     F.col(f"{s}.exit_reason").alias("exit_reason")) for s in ("long", "short")]))
    d = labelled.select(*id_cols, "cost_r", e.alias("_o")).select(*id_cols, "cost_r", "_o.*")
    return d.withColumns({
        "row_id": P.row_id("symbol", F.unix_millis("ts"), "side"),
        "is_valid": (F.col("net_r") != 0) | (F.col("bars_held") > 0),
        "profit_bucket": P.profit_bucket("net_r"), "is_profitable_state": F.col("net_r") > 0,
        "is_strong_win": F.col("net_r") > 0.5, "is_bad_state": F.col("net_r") < -0.5})


def noise_robustness(df: DataFrame, n_seeds: int, sigma: float, horizon: int = 12, stop: float = 1.5,
                     target: float = 1.5) -> DataFrame:
    """Relabel the long side under perturbed paths; distribution of the gross R per row.

    Draws come from a hash of (symbol, ts, seed, step), so every run and every
    plan gives the same numbers.  ``n_seeds`` results per row are aggregated
    inside the row.
    """
    df = with_path(df, horizon).withColumns({"atr": trailing_atr(15), "_more": F.lead("rn", horizon + 1).over(frame())})
    df = df.filter(F.col("core") & F.col("_more").isNotNull()).drop("_more")
    df = df.withColumns({**P.stop_target_levels("close", "atr", stop, target), "risk": P.entry_risk("atr", stop)})
    df = df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))))

    def noise(step):
        def u(tag):
            h = F.xxhash64("symbol", F.unix_micros("ts"), "seed", step, F.lit(tag))
            return (F.pmod(h, F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
        return F.sqrt(-2.0 * F.log(u("a"))) * F.cos(2.0 * math.pi * u("b"))

    def perturbed(col):
        return F.transform(F.col(col), lambda x, i: x * (1.0 + F.lit(sigma) * noise(i)))

    df = df.withColumns({"_h2": perturbed("_hi"), "_l2": perturbed("_lo"), "_c2": perturbed("_cl")})
    df = barrier_exit(df, "x", "LONG", "close", "long_stop", "long_target", "risk", hi="_h2", lo="_l2", cl="_c2")
    g = df.groupBy("symbol", "ts").agg(
        F.avg("x.gross_r").alias("mean_r"), F.stddev_pop("x.gross_r").alias("std_r"),
        F.avg((F.col("x.exit_reason") == "STOP_HIT").cast("double")).alias("p_stop"),
        F.avg((F.col("x.exit_reason") == "TARGET_HIT").cast("double")).alias("p_target"),
        F.array_sort(F.collect_list("x.gross_r")).alias("_r"))
    k = F.greatest(F.lit(1), F.floor(F.size("_r") * 0.05)).cast("int")
    tail = F.slice("_r", F.lit(1), k)
    return g.withColumn("cvar_5", F.aggregate(tail, F.lit(0.0), lambda a, b: a + b) / k) \
        .withColumn("stability", 1.0 / (1.0 + F.col("std_r"))).drop("_r")


def exclude_rows(labels: DataFrame, validity: str = "label_validity") -> DataFrame:
    return labels.filter(~F.col(validity).isin("INVALID", "AMBIGUOUS"))


def purge_violations(df: DataFrame, feature_ts: str, label_ts: str) -> DataFrame:
    """Rows whose features are not older than their label."""
    return df.filter(F.col(feature_ts) >= F.col(label_ts))


def meta_label(pred, actual, min_return: float = 0.001) -> Column:
    return ((F.signum(c(pred)) == F.signum(c(actual))) & (F.abs(c(actual)) >= min_return)).cast("int")


def lineage_checksum(*cols) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["lag", "r_mean", "blocked", "core_rows"]

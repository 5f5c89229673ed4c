"""Trading rules per row: costs, levels, quality ladders, decisions (P15..P36)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barlens.functions.core import c, div

# fixed values: fee, slippage and fill assumptions
TAKER_BPS, MAKER_BPS, SLIPPAGE_BPS, MAKER_FILL = 4.0, 2.0, 1.0, 0.7


def ladder(x, steps: list[tuple[float, str]], last: str, strict: bool = False) -> Column:
    """First label whose bound x does not exceed (``strict``: stays below)."""
    x = c(x)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when(x < bound if strict else x <= bound, label)
    return out.otherwise(last)


# ---- regime filter ---------------------------------------------------------

# fixed values per mode: block on CUSUM hit, high-volatility state, volatility regime, probability
REGIME_FILTER = {"SWING": (0.5, 1.0, 2.0, 0.8), "SCALP": (0.5, 1.0, 1.5, 0.6), "AGGRESSIVE_SCALP": (0.5, 1.0, 1.0, 0.5)}


def regime_blocks(cusum, state, vol, prob, mode: str = "SWING") -> dict[str, Column]:
    """Which rule blocks the bar; NULL never blocks."""
    a, b, v, p = REGIME_FILTER[mode]
    no = F.lit(False)
    return {"blocked_by_cusum": F.coalesce(c(cusum) >= a, no), "blocked_by_hmm_state": F.coalesce(c(state) >= b, no),
            "blocked_by_vol_regime": F.coalesce(c(vol) >= v, no), "blocked_by_hmm_prob": F.coalesce(c(prob) > p, no)}


def trade_allowed(blocks: dict[str, Column]) -> Column:
    hit = F.lit(False)
    for b in blocks.values():
        hit = hit | b
    return ~hit


def trend_score(price, e9, e21, e50, e200) -> tuple[Column, Column]:
    """Label and strength from EMA stack, distance to EMA50 and side of EMA200."""
    price, e9, e21, e50, e200 = map(c, (price, e9, e21, e50, e200))
    stack_known = e9.isNotNull() & e21.isNotNull() & e50.isNotNull()
    up, down = (e9 > e21) & (e21 > e50), (e9 < e21) & (e21 < e50)
    d = div(price - e50, F.abs(e50)) * 100.0
    d = F.when(price.isNotNull() & e50.isNotNull(), F.coalesce(d, F.lit(0.0)))
    zero = F.lit(0.0)
    total = (F.when(stack_known, F.when(up | down, 2.0).otherwise(1.0)).otherwise(zero)
             + F.when((d > 0.2) | (d < -0.2), 1.0).otherwise(zero)
             + F.when(price.isNotNull() & e200.isNotNull(), 0.5).otherwise(zero))
    bull = (F.when(stack_known & up, 2.0).otherwise(zero) + F.when(d > 0.2, 1.0).otherwise(zero)
            + F.when(price > e200, 0.5).otherwise(zero))
    ratio = div(bull, total)
    label = F.when(ratio >= 0.67, "BULLISH").when(ratio <= 0.33, "BEARISH").otherwise("MIXED")
    return label, F.coalesce(F.bround(ratio * 100.0, 1), F.lit(50.0))


# ---- costs --------------------------------------------------------------------

def entry_risk(atr, stop_mult) -> Column:
    atr, stop_mult = c(atr), c(stop_mult)
    return F.when((atr > 0) & (stop_mult > 0), atr * stop_mult).otherwise(0.0)


def fee_r(notional, risk, mode=None) -> Column:
    """Entry plus exit fee in R; mode TAKER, MAKER (blended by fill probability) or HYBRID."""
    notional, risk = c(notional), c(risk)
    t, m = TAKER_BPS / 1e4, MAKER_BPS / 1e4
    blend = m + (t - m) * (1.0 - MAKER_FILL)
    rate = F.lit(2 * t) if mode is None else \
        F.when(c(mode) == "MAKER", 2 * blend).when(c(mode) == "HYBRID", m + t).otherwise(2 * t)
    return F.when((risk > 0) & (notional > 0), div(notional * rate, risk)).otherwise(0.0)


def slippage_r(notional, price, risk, atr, adjust: bool = True) -> Column:
    notional, price, risk, atr = map(c, (notional, price, risk, atr))
    rate = F.lit(SLIPPAGE_BPS / 1e4)
    if adjust:
        rate = F.when(atr > 0, rate * (1.0 + div(atr, price))).otherwise(rate)
    return F.when((risk > 0) & (price > 0), div(2.0 * notional * rate, risk)).otherwise(0.0)


def funding_cost(notional, rate, bars, side) -> Column:
    return F.when(c(side) == "SHORT", -1.0).otherwise(1.0) * c(notional) * c(rate) * c(bars)


def total_cost_r(notional, price, atr, stop_mult, funding_rate=0.0, bars=0, mode=None) -> Column:
    risk = entry_risk(atr, stop_mult)
    fund = F.when(risk > 0, div(c(notional) * c(funding_rate) * c(bars), risk)).otherwise(0.0)
    return fee_r(notional, risk, mode) + slippage_r(notional, price, risk, atr) + fund


# fixed values: simple percentage cost model
SIMPLE_MAKER, SIMPLE_TAKER, SIMPLE_FUNDING = 0.0001, 0.0004, 0.0001
MAX_FUNDING_INTERVALS = {"SWING": 15.0, "SCALP": 2.0, "AGGRESSIVE_SCALP": 0.0}


def simple_fee_r(notional, atr, stop_mult, tier) -> Column:
    rate = F.when(c(tier) == "maker", SIMPLE_MAKER).otherwise(SIMPLE_TAKER)
    return F.coalesce(div(c(notional) * rate, _positive(entry_risk(atr, stop_mult))), F.lit(0.0))


def simple_slippage_r(notional, atr, stop_mult, liquidity) -> Column:
    pct = F.when(c(liquidity) > 0, 0.01 * F.greatest(F.lit(1.0), div(notional, liquidity))).otherwise(0.0)
    return F.coalesce(div(c(notional) * pct / 100.0, _positive(entry_risk(atr, stop_mult))), F.lit(0.0))


def funding_impact_r(notional, atr, stop_mult, mode, direction, hours=None, rate: float = SIMPLE_FUNDING) -> Column:
    n = F.when(c(mode) == "SWING", MAX_FUNDING_INTERVALS["SWING"]).when(
        c(mode) == "SCALP", MAX_FUNDING_INTERVALS["SCALP"]).otherwise(0.0)
    if hours is not None:
        n = F.when(c(hours).isNotNull(), F.greatest(c(hours), F.lit(0.0)) / 8.0).otherwise(n)
    sign = F.when(c(direction) == "LONG", 1.0).otherwise(-1.0)
    return F.coalesce(div(sign * n * rate * c(notional), _positive(entry_risk(atr, stop_mult))), F.lit(0.0))


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def funding_status(has_list, matching, legacy) -> Column:
    return (F.when(~c(has_list) & c(legacy), "LEGACY_SCALAR").when(~c(has_list), "MISSING_DATA")
            .when(c(matching) > 0, "APPLIED").otherwise("AVAILABLE_EMPTY"))


def stop_target_levels(entry, atr, stop_mult, target_mult) -> dict[str, Column]:
    e, s, t = c(entry), c(atr) * c(stop_mult), c(atr) * c(target_mult)
    return {"long_stop": e - s, "long_target": e + t, "short_stop": e + s, "short_target": e - t}


# ---- outcome quality ------------------------------------------------------------

def path_quality(mfe_r, mae_r) -> Column:
    ratio = c(mfe_r) / F.greatest(F.abs(c(mae_r)), F.lit(0.001))
    return (F.when(c(mfe_r) <= 0, 0.0).when(ratio >= 2.0, 0.85).when(ratio >= 1.0, 0.6)
            .when(ratio >= 0.5, 0.4).otherwise(0.2))


def path_quality_bucket(score) -> Column:
    return F.when(c(score) >= 0.7, "HIGH").when(c(score) >= 0.4, "MEDIUM").otherwise("LOW")


def action_utility(net, mae_r, cost, time_to_mfe, w_mae=1.0, w_cost=1.0, w_time=0.3) -> Column:
    return c(net) - w_mae * F.abs(c(mae_r)) - w_cost * c(cost) - w_time * c(time_to_mfe) * 0.1


def no_trade_outcome(long_net, short_net, stop_mult, target_mult, min_edge, margin) -> dict[str, Column]:
    worst, best = F.least(c(long_net), c(short_net)), F.greatest(c(long_net), c(short_net))
    saved = F.greatest(F.lit(0.0), -worst)
    missed = F.when(best > min_edge, best).otherwise(0.0)
    s, m = saved > 0, missed > 0
    quality = (F.when(~s & ~m, "CORRECT_NO_TRADE").when(s & ~m, "SAVED_LOSS").when(m & ~s, "MISSED_OPPORTUNITY")
               .when(F.abs(saved - missed) < margin, "AMBIGUOUS_NO_TRADE").when(saved >= missed, "SAVED_LOSS")
               .otherwise("MISSED_OPPORTUNITY"))
    return {"saved_loss_r": saved, "missed_opportunity_r": missed,
            "saved_loss_score": F.least(F.lit(1.0), saved / F.greatest(c(stop_mult), F.lit(0.01))),
            "missed_opportunity_score": F.least(F.lit(1.0), missed / F.greatest(c(target_mult), F.lit(0.01))),
            "no_trade_quality": quality,
            "was_correct_skip": quality.isin("CORRECT_NO_TRADE", "SAVED_LOSS")}


def best_action(u_long, u_short, saved, missed, margin, no_trade_default: bool = True) -> dict[str, Column]:
    """Rank the three utilities; a gap below the margin is ambiguous."""
    u_none = c(saved) - c(missed) * 0.5
    rows = [F.struct((-u).alias("n"), F.lit(i).alias("i"), F.lit(a).alias("a"))
            for i, (u, a) in enumerate([(c(u_long), "LONG_NOW"), (c(u_short), "SHORT_NOW"), (u_none, "NO_TRADE")])]
    r = F.array_sort(F.array(*rows))
    gap = r[1]["n"] - r[0]["n"]
    unsure = gap < margin
    return {"best_action": F.when(unsure, "NO_TRADE" if no_trade_default else "AMBIGUOUS_STATE").otherwise(r[0]["a"]),
            "second_best_action": r[1]["a"],
            "action_gap_r": F.when(unsure, 0.0).otherwise(gap) if no_trade_default else gap, "is_ambiguous": unsure}


def profit_bucket(r) -> Column:
    return ladder(r, [(-0.5, "big_loss"), (-0.1, "loss"), (0.0, "breakeven"), (0.1, "small_win"), (0.5, "win")], "big_win")


def excess_bucket(r) -> Column:
    return ladder(r, [(-0.3, "far_below_baseline"), (-0.05, "below_baseline"), (0.05, "at_baseline"),
                      (0.3, "above_baseline")], "far_above_baseline")


def confidence_band(x) -> Column:
    return ladder(F.coalesce(c(x), F.lit(0.0)), [(40, "0-40"), (60, "40-60"), (80, "60-80")], "80-100", strict=True)


def confidence_decile(x) -> Column:
    lo = F.greatest(F.lit(0), F.least(F.lit(90), F.floor(c(x) / 10.0) * 10)).cast("int")
    return F.concat_ws("-", lo.cast("string"), (lo + 10).cast("string"))


def volatility_bucket(ratio) -> Column:
    r = F.coalesce(c(ratio), F.lit(0.0))
    return (F.when(r >= 1.5, "HIGH_VOL").when(r >= 1.0, "NORMAL_VOL").when(r > 0, "LOW_VOL").otherwise("UNKNOWN"))


def row_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("_", *[c(p).cast("string") for p in parts]), 256), 1, 16)


# fixed values per mode: smallest edge, ambiguity margin
LABEL_THRESHOLDS = {"SWING": (0.35, 0.2), "SCALP": (0.15, 0.1), "AGGRESSIVE_SCALP": (0.08, 0.05)}


def label_from_outcome(mode, status, ambiguous, long_net, short_net) -> dict[str, Column]:
    mode, ln_, sn = c(mode), c(long_net), c(short_net)
    edge, margin = _by_mode(mode, 0, 0.15), _by_mode(mode, 1, 0.1)
    bad = c(status).isin("UNRESOLVED", "INVALIDATED")
    unsure = c(ambiguous) | (F.abs(ln_ - sn) < margin)
    return {"label_validity": F.when(bad, "INVALID").when(unsure, "AMBIGUOUS").otherwise("VALID"),
            "best_action_label": F.when(bad, "INVALID_OR_UNRESOLVED").when(unsure, "AMBIGUOUS_STATE")
            .when(F.greatest(ln_, sn) < edge, "NO_TRADE").when(ln_ > sn, "LONG_NOW").otherwise("SHORT_NOW")}


def _by_mode(mode: Column, i: int, default: float) -> Column:
    out = F
    for m, v in LABEL_THRESHOLDS.items():
        out = out.when(mode == m, v[i])
    return out.otherwise(default)


# fixed values per mode: least alpha, confidence, expected R
POLICY = {"SWING": (0.2, 0.58, 0.35), "SCALP": (0.1, 0.6, 0.15), "AGGRESSIVE_SCALP": (0.06, 0.65, 0.08)}


def policy_decision(mode, confidence, long_alpha, short_alpha, long_r, short_r, regime) -> dict[str, Column]:
    """Action from mode thresholds and regime blocks, with the gates that failed."""
    mode, la, sa = c(mode), c(long_alpha), c(short_alpha)

    def need(i):
        out = F
        for m in ("SCALP", "AGGRESSIVE_SCALP"):
            out = out.when(mode == m, POLICY[m][i])
        return out.otherwise(POLICY["SWING"][i])

    gates = {"confidence_gate": c(confidence) >= need(1), "long_alpha_gate": la >= need(0),
             "short_alpha_gate": sa >= need(0), "long_expected_r_gate": c(long_r) >= need(2),
             "short_expected_r_gate": c(short_r) >= need(2),
             "regime_long_gate": F.coalesce(c(regime) != "TREND_DOWN", F.lit(True)),
             "regime_short_gate": F.coalesce(c(regime) != "TREND_UP", F.lit(True))}
    lp = gates["long_alpha_gate"] & gates["long_expected_r_gate"] & gates["regime_long_gate"]
    sp = gates["short_alpha_gate"] & gates["short_expected_r_gate"] & gates["regime_short_gate"]
    ok = gates["confidence_gate"]
    action = (F.when(~ok, "NO_TRADE").when(lp & (~sp | (la >= sa)), "LONG_NOW").when(sp, "SHORT_NOW").otherwise("NO_TRADE"))
    failed = F.filter(F.array(*[F.when(~g, F.lit(n)) for n, g in gates.items()]), lambda x: x.isNotNull())
    return {"recommended_action": action, "failed_gates": failed}


def regret(long_net, short_net, chosen_net, long_mae, short_mae, saved, missed, mode) -> Column:
    """Best of long, short and no trade (penalised by drawdown) minus the chosen result."""
    lam = F.when(c(mode) == "SCALP", 1.0).when(c(mode) == "AGGRESSIVE_SCALP", 2.0).otherwise(0.5)
    best = F.greatest(c(long_net) - lam * F.abs(c(long_mae)), c(short_net) - lam * F.abs(c(short_mae)),
                      c(saved) - 0.5 * c(missed))
    return F.greatest(F.lit(0.0), best - c(chosen_net))


def reliability(n, least) -> Column:
    return F.when(c(n) < c(least), "LOW_SAMPLE").when(c(n) < c(least) * 2, "BUILDING_SAMPLE").otherwise("STABLE")


def component_reliability(n, least: int) -> Column:
    return (F.when(c(n) < max(3, least // 2), "LOW_SAMPLE").when(c(n) < least, "BUILDING_SAMPLE")
            .when(c(n) < least * 2, "MIXED").otherwise("STABLE"))


def time_stop_cause(r, error_ratio, hold_min, interval_min) -> Column:
    r = F.coalesce(c(r), F.lit(0.0))
    e = F.coalesce(c(error_ratio), F.lit(0.0))
    early = (c(hold_min) <= F.greatest(c(interval_min), F.lit(1.0)) * 0.75) & (r <= 0.15)
    return (F.when(early, "never_developed").when(r <= -0.4, "late_reversal")
            .when((e > 0.25) & (r <= 0.1), "stale_range_bound_hold").when(F.abs(r) <= 0.2, "stale_range_bound_hold")
            .when(r < 0, "slow_drift").otherwise("never_developed"))


def failure_record(close_reason, r, direction, trend, regime, late_entry=None, stop_atr=None) -> dict[str, Column]:
    """Rule-based reading of a losing trade: source, component, class, severity.

    ``late_entry`` marks a stretched entry, ``stop_atr`` is the stop distance in ATR.
    """
    cr, r, d, t, g = map(c, (close_reason, r, direction, trend, regime))
    late = F.coalesce(c(late_entry), F.lit(False)) if late_entry is not None else F.lit(False)
    dist = F.coalesce(c(stop_atr), F.lit(0.0)) if stop_atr is not None else F.lit(0.0)
    tight, hostile = (dist > 0) & (dist < 1.1), g.isin("HIGH_VOL", "MOMENTUM")
    timing = cr.isin("TIME_STOP", "EARLY_STALE_EXIT")
    against = (d.isin("BUY", "LONG") & (t == "BEARISH")) | (d.isin("SELL", "SHORT") & (t == "BULLISH"))
    quiet = g.isin("SQUEEZE", "DEAD")
    stop, manual = cr == "HIT_SL", cr == "MANUAL_CLOSE"
    cls = (F.when(stop & late, "ENTRY_TOO_LATE").when(stop & tight, "STOP_TOO_TIGHT")
           .when(stop & hostile, "REGIME_MISMATCH").when(stop, "STOP_STRUCTURALLY_WRONG")
           .when(cr == "EARLY_STALE_EXIT", "EARLY_STALE_EXIT")
           .when(timing & (r <= -0.4), "LATE_REVERSAL").when(timing & (F.abs(r) <= 0.2), "STALE_RANGE_HOLD")
           .when(timing & (r < 0), "SLOW_DRIFT").when(timing, "NEVER_DEVELOPED").when(manual, "MANUAL_INVALIDATION")
           .when(against, "WRONG_DIRECTION").when(quiet, "LOW_PARTICIPATION").otherwise("WEAK_CONFIRMATION"))
    source = (F.when(stop & late, "TIMING").when(stop & tight, "RISK_MODEL").when(stop & hostile, "MARKET_CONDITION")
              .when(stop, "RISK_MODEL").when(timing, "TIMING").when(manual, "THRESHOLD_LOGIC")
              .when(against, "SIGNAL_QUALITY").when(quiet, "MARKET_CONDITION").otherwise("SIGNAL_QUALITY"))
    comp = (F.when(stop & late, "Entry Logic").when(stop, "Stop Loss").when(timing, "Entry Logic")
            .when(manual, "Take Profit").when(against, "Trend Filter").when(quiet, "Volume").otherwise("MACD"))
    sev = F.when(r <= -2.0, 5).when(r <= -1.5, 4).when(r <= -1.0, 3).otherwise(2)
    return {"failure_source": source, "blamed_component": comp, "classification": cls, "severity_score": sev}


def outcome_label(r) -> Column:
    r = c(r)
    return F.when(r.isNull(), "OPEN").when(r > 0, "WIN").when(r < 0, "LOSS").otherwise("FLAT")


def orderbook_snapshot(bids, asks, depth: int = 10) -> dict[str, Column]:
    """Spread, depth imbalance and microprice deviation from arrays of (price, qty)."""
    b, a = c(bids), c(asks)
    bid, ask = F.get(b, F.lit(0))["price"], F.get(a, F.lit(0))["price"]

    def total(x):
        return F.aggregate(F.slice(x, 1, depth), F.lit(0.0), lambda s, q: s + q["qty"])

    bd, ad = total(b), total(a)
    mid = (bid + ask) / 2.0
    tot = bd + ad
    micro = F.when(tot > 0, div(ask * bd + bid * ad, tot)).otherwise(mid)
    return {"best_bid": bid, "best_ask": ask, "spread_bps": div(ask - bid, mid) * 1e4,
            "imbalance": F.coalesce(div(bd - ad, tot), F.lit(0.0)), "microprice_deviation_bps": div(micro - mid, mid) * 1e4}

"""Stateful regime detectors: CUSUM with restart and the two-state volatility filter (W52, W53).

Both are ordered passes over chunks with exact state hand-over (``plans.ordered_pass``); what a chunk does to the CUSUM is summed up, so its states are folded.  Inside a chunk nothing runs row by row:

* Between two hits a one-sided CUSUM is the running sum less its running minimum, so a scan gives a stretch of rows at
  once and the first value above the limit ends it.
* While the filter stays on one side, only that side's level moves, and it is an exponential mean of squares in closed form.
  The odds then follow a chain of 2 x 2 matrices (transition times likelihoods), whose products come from a prefix scan by doubling.
  The first row that changes sides ends the stretch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barlens.functions.core import div, ln
from barlens.operators.windows import lag
from barlens.plans.first_touch import Extremes
from barlens.plans.ordered import blocked, core_rows
from barlens.plans.ordered_pass import ROWS_PER_CHUNK, folded_pass, ordered_pass

STRETCH = (32, 1024)  # rows tried at once, at least and at most
TINY = 1e-150  # a level of zero


def with_returns(bars: DataFrame) -> DataFrame:
    b = blocked(bars, 1)
    b = b.withColumn("log_ret", ln(div(F.col("close"), lag("close"))))
    return core_rows(b.withColumn("pos", F.col("rn")))


def restarting_sum(steps: np.ndarray, level: float, limit: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, hits, last level): a sum that never falls below 0 and starts again at 0 once it exceeds ``limit``."""
    sums, hits = np.zeros(len(steps)), np.zeros(len(steps), dtype=bool)
    at, span = 0, STRETCH[0]
    while at < len(steps):
        s = level + np.cumsum(steps[at:at + span])
        s -= np.minimum(np.minimum.accumulate(s), 0.0)
        over = np.flatnonzero(s > limit)
        n = int(over[0]) + 1 if len(over) else len(s)
        sums[at:at + n] = s[:n]
        if len(over):
            hits[at + n - 1], sums[at + n - 1] = True, 0.0
        level, at, span = float(sums[at + n - 1]), at + n, STRETCH[0] if len(over) else min(2 * span, STRETCH[1])
    return sums, hits, level


def two_sided(returns: np.ndarray, levels: tuple[float, float], threshold: float, drift: float):
    """Sums above and below of some returns (missing ones count as 0), hits, and the levels after them.

    One step moves both sides in one direction, so the sides never hit together and each can be scanned alone.
    """
    steps = np.nan_to_num(returns, nan=0.0) - drift
    up, hit_up, a = restarting_sum(steps, levels[0], threshold)
    down, hit_down, b = restarting_sum(-steps, levels[1], threshold)
    return up, down, (hit_up | hit_down).astype(float), (a, b)


def _aligned(n: int, **columns) -> pd.DataFrame:
    """Columns that begin ``n - len`` rows later, with None where a row has no value."""
    out = {k: np.concatenate([np.full(n - len(v), np.nan), v]) for k, v in columns.items()}
    return pd.DataFrame(out).astype(object).where(lambda q: q.notna(), None)


def sum_map(steps: np.ndarray, limit: float) -> list[float]:
    """What some steps make of any level that a restarting sum has before them.

    A level s first falls to 0 where the plain sum of the steps reaches -s, or starts again at 0 where it exceeds limit - s,
    whichever is first; the records of the plain sum downwards and upwards tell both.  From 0 on, what follows depends on
    the place only, and the next place at 0 is again a first reach, so the end level of every place comes from doubling.
    Without either the sum is added.  Returned: the plain sum, then for both kinds the number of records and their level, place and end level.
    """
    n, s = len(steps), np.cumsum(steps)
    if not n:
        return [0.0, 0.0, 0.0]
    at = np.arange(n)
    nxt = np.minimum(Extremes(s, False, n).first(at + 1, np.full(n, n), s), Extremes(s, True, n).first(at + 1, np.full(n, n), np.nextafter(s + limit, np.inf)))
    jump, last = np.append(nxt, n), at.copy()
    jumps = [jump]
    while (jumps[-1][:n] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    for jump in reversed(jumps):
        to = jump[last]
        last = np.where(to < n, to, last)
    ends = s[-1] - s[last]
    out = [float(s[-1])]
    for record in (-s, s):
        best = np.maximum.accumulate(record)
        # levels lie between 0 and the limit, so the first record beyond the limit is the last one needed
        new = np.flatnonzero((best >= 0) & (np.append(-np.inf, best[:-1]) < best) & (np.append(-np.inf, best[:-1]) <= limit))
        out += [float(len(new)), *best[new], *new.astype(float), *ends[new]]
    return out


def sum_through(summed: list[float], level: float, limit: float) -> tuple[float, list[float]]:
    """The level after the steps that ``summed`` (from :func:`sum_map`) stands for, and what is left of the list."""
    total, rest, found = summed[0], summed[1:], []
    for falls in (True, False):
        n = int(rest[0])
        best, place, end = (np.array(rest[1 + i * n:1 + (i + 1) * n]) for i in range(3))
        rest = rest[1 + 3 * n:]
        i = int(np.searchsorted(best, level, side="left")) if falls else int(np.searchsorted(best, limit - level, side="right"))
        if i < n:
            found.append((place[i], float(end[i])))
    return (min(found)[1] if found else level + total), rest


def cusum(bars: DataFrame, threshold: float = 5.0, drift: float = 0.0, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The first bar of a symbol has no return and no value.  Chunks are summed up by :func:`sum_map`, so two passes do."""
    def returns(pdf: pd.DataFrame) -> np.ndarray:
        return pdf["log_ret"].to_numpy(float)[int(pdf["pos"].iloc[0] == 0):]

    def step(pdf: pd.DataFrame, state):
        up, down, hit, end = two_sided(returns(pdf), tuple(state or (0.0, 0.0)), threshold, drift)
        return _aligned(len(pdf), cusum_positive=up, cusum_negative=down, cusum_signal=hit), list(end)

    def summary(pdf: pd.DataFrame) -> list[float]:
        steps = np.nan_to_num(returns(pdf), nan=0.0) - drift
        return sum_map(steps, threshold) + sum_map(-steps, threshold)

    def advance(summed: list[float], state) -> list[float]:
        up, rest = sum_through(summed, (state or (0.0, 0.0))[0], threshold)
        return [up, sum_through(rest, (state or (0.0, 0.0))[1], threshold)[0]]

    r = folded_pass(with_returns(bars), step, summary, advance, "cusum_positive double, cusum_negative double, cusum_signal double", rows_per_chunk=rows_per_chunk)
    return r.drop("pos")


def _log_odds(start: float, ratio: np.ndarray, stay: float) -> np.ndarray:
    """Log odds after each row: odds -> ratio * (stay * odds + leave) / (leave * odds + stay), as products of matrices."""
    leave = 1.0 - stay
    gain = np.exp(np.clip(ratio, -700, 700) / 2)  # spread over both rows of the matrix, so neither overflows
    m = np.empty((len(ratio), 2, 2))
    m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1] = stay * gain, leave * gain, leave / gain, stay / gain
    m /= m.max(axis=(1, 2), keepdims=True)
    reach = 1
    while reach < len(m):
        m[reach:] = m[reach:] @ m[:-reach]
        m /= m.max(axis=(1, 2), keepdims=True)
        reach *= 2
    p = 1.0 / (1.0 + np.exp(-np.clip(start, -700, 700)))
    v = m @ np.array([p, 1.0 - p])
    with np.errstate(divide="ignore"):
        return np.log(v[:, 0]) - np.log(v[:, 1])


def _mean_squares(x: np.ndarray, level: float, stay: float) -> np.ndarray:
    """Root of the exponential mean of squares before each row and after the last."""
    age = stay ** np.arange(len(x) + 1)
    return np.sqrt(age * (level * level + np.concatenate([[0.0], np.cumsum((1.0 - stay) * x * x / age[1:])])))


def filtered(returns: np.ndarray, odds: float | None, low: float, high: float, stay: float, factor: float):
    """(probability of the high side per row, log odds, low, high after the last row).

    ``odds`` are log odds before the first row; None takes them from the likelihoods of that row.
    """
    def ratio(x, lo, hi):
        lo, hi = np.maximum(lo, TINY), np.maximum(hi, TINY)
        return np.log(lo) - np.log(hi) + 0.5 * (x / lo) ** 2 - 0.5 * (x / hi) ** 2

    out, at, span = np.empty(len(returns)), 0, STRETCH[0]
    side = None if odds is None else odds > 0
    while at < len(returns):
        x = returns[at:at + span]
        if odds is None:
            odds = float(ratio(x[0], low, high))
            side = odds > 0
        moving = _mean_squares(x, high if side else low, stay)
        lo, hi = (np.full(len(x), low), moving[:-1]) if side else (moving[:-1], np.full(len(x), high))
        path = _log_odds(odds, ratio(x, lo, hi), stay)
        # the stretch ends with the row that changes sides, or that would bring the levels together
        ends = np.flatnonzero(((path > 0) != side) | ((low if side else moving[1:]) >= (moving[1:] if side else high)))
        n = int(ends[0]) + 1 if len(ends) else len(x)
        out[at:at + n], odds = path[:n], float(path[n - 1])
        if (odds > 0) == side:
            low, high = (low, float(moving[n])) if side else (float(moving[n]), high)
        else:  # the last row's return went to the other side's level
            low, high = (low, float(moving[n - 1])) if side else (float(moving[n - 1]), high)
            new = float(_mean_squares(x[n - 1:n], low if side else high, stay)[1])
            low, high = (new, high) if side else (low, new)
            side = not side
        if high <= low:
            high = low * factor
        at, span = at + n, STRETCH[0] if len(ends) else min(2 * span, STRETCH[1])
    return 1.0 / (1.0 + np.exp(-np.clip(out, -700, 700))), odds, low, high


def vol_state(bars: DataFrame, window: int = 20, stay: float = 0.85, factor: float = 2.0, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Two-state filter whose levels start from the first ``window`` returns of the symbol."""
    x = with_returns(bars)
    init = x.filter(F.col("pos").between(1, window)).groupBy("symbol").agg(
        F.percentile(F.abs("log_ret"), F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count("log_ret").alias("_n"))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1)) * 1.5
    init = init.filter(F.col("_n") >= window).select("symbol", lo.alias("low0"), F.greatest(hi, lo * factor).alias("high0"))
    x = x.join(init, "symbol", "left")

    def step(pdf: pd.DataFrame, state):
        begin = max(0, window + 1 - int(pdf["pos"].iloc[0]))
        if pdf["low0"].isna().iloc[0] or begin >= len(pdf):
            return _aligned(len(pdf), hmm_vol_state=np.zeros(0), hmm_vol_probability=np.zeros(0)), list(state or [])
        low0, high0 = (float(pdf[k].iloc[0]) for k in ("low0", "high0"))
        odds, low, high = state if state else (None, low0, high0 if high0 > low0 else low0 * factor)
        p, *end = filtered(pdf["log_ret"].to_numpy(float)[begin:], odds, low, high, stay, factor)
        return _aligned(len(pdf), hmm_vol_state=(p > 0.5).astype(float), hmm_vol_probability=p), end

    return ordered_pass(x, step, "hmm_vol_state double, hmm_vol_probability double", rows_per_chunk=rows_per_chunk).drop("pos", "low0", "high0")


__all__ = ["with_returns", "restarting_sum", "two_sided", "sum_map", "sum_through", "cusum", "filtered", "vol_state"]

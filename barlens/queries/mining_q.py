"""Queries: rule mining (M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.operators import mining as M, splits as SP
from barlens.queries.joins_q import with_hold
from barlens.queries.registry import cte, query
from barlens.session import cut_lineage, written
from barlens.sources import tables as S

FEATS = ["atr_pct", "momentum_score", "volume_z", "regime_score"]


def mined(spark, d):
    t = with_hold(S.trades(spark, d))
    return t.select("order_id", "closed_at", "symbol", "regime", F.col("notional_k").alias("atr_pct"), F.col("confidence").alias("momentum_score"),
                    F.col("hold_minutes").alias("volume_z"), F.col("expected_candles").alias("regime_score"),
                    (F.col("realized_r") + F.when(F.col("notional_k") > 60, 0.1).otherwise(0.0)).alias("net_r"))


def conditioned(spark, d):
    """The condition table is written once; every scan below reads it."""
    x = written(mined(spark, d), "mined")
    return written(M.bucketize(x, M.fit_deciles(x, FEATS)).drop(*FEATS), "conditions")


cte("mx", "SELECT order_id, closed_at, symbol, regime, notional_k AS atr_pct, confidence AS momentum_score, hold_minutes AS volume_z, expected_candles AS regime_score, realized_r + CASE WHEN notional_k > 60 THEN 0.1 ELSE 0 END AS net_r FROM ts_e")
cte("mcuts", " UNION ALL ".join(f"SELECT '{f}' AS feature, quantile_cont({f}::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM mx" for f in FEATS))


def _dec(f):
    return f"(SELECT 1 + len(list_filter(c, lambda t: x.{f} > t)) FROM mcuts WHERE feature = '{f}')"


def _dom(dom, q):
    from barlens.operators.mining import DOMAINS
    return "CASE " + " ".join(f"WHEN {q} BETWEEN {lo} AND {hi} THEN '{n}'" for n, (lo, hi) in DOMAINS[dom].items()) + " END"


cte("mdec", "SELECT x.*, " + ", ".join(f"{_dec(f)} AS d{i}" for i, f in enumerate(FEATS)) + " FROM mx x")
cte("mcond", f"""
SELECT order_id, closed_at, symbol, regime, net_r, list_sort([concat('atr_pct__d', lpad(d0::VARCHAR, 2, '0')), concat('momentum_score__d', lpad(d1::VARCHAR, 2, '0')), concat('volume_z__d', lpad(d2::VARCHAR, 2, '0')), concat('regime_score__d', lpad(d3::VARCHAR, 2, '0')),
  concat('atr_pct__', {_dom('volatility', 'd0')}), concat('momentum_score__', {_dom('momentum', 'd1')}), concat('regime_score__', {_dom('regime', 'd3')})]) AS conds FROM mdec""")
cte("mex", "SELECT order_id, net_r, unnest(conds) AS c FROM mcond")
_TM = "(SELECT avg(net_r) FROM mcond)"
_N = "(SELECT count(*) FROM mcond)"


@query("M1_fit_deciles", "feature " + " ".join(f"p{i}#4" for i in range(1, 10)), "SELECT feature, " + ", ".join(f"c[{i}] AS p{i}" for i in range(1, 10)) + " FROM mcuts")
def _(spark, d):
    x = mined(spark, d)
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in FEATS])
    from barlens.plans.quantiles import exact_quantiles
    return exact_quantiles(x.select(F.explode(arr).alias("e")).select("e.*"), ["feature"], "x", {f"p{i}": i / 10 for i in range(1, 10)})


@query("M2_bucketize", "order_id conditions", "SELECT order_id, array_to_string(conds, ',') AS conditions FROM mcond")
def _(spark, d):
    return conditioned(spark, d).withColumn("conditions", F.array_join("conditions", ","))


@query("M3_condition_registry", "condition support!", f"SELECT c AS condition, count(*) AS support FROM mex GROUP BY 1 HAVING count(*) >= 0.05 * {_N}")
def _(spark, d):
    return M.condition_registry(conditioned(spark, d), 0.05)


@query("M4_level1_scan", "condition support! support_frac# mean_r# win_rate# lift#4", f"""
SELECT c AS condition, count(*) AS support, count(*) / {_N} AS support_frac, avg(net_r) AS mean_r, avg(CASE WHEN net_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(net_r) / {_TM} AS lift FROM mex GROUP BY 1 HAVING count(*) >= ceil(0.01 * {_N})""")
def _(spark, d):
    return M.level1_scan(conditioned(spark, d), "net_r")


cte("mpair", f"""
SELECT a.c AS a, b.c AS b, count(*) AS support, avg(a.net_r) AS mean_r, avg(CASE WHEN a.net_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, sum(a.net_r) AS s FROM mex a JOIN mex b ON a.order_id = b.order_id AND a.c < b.c GROUP BY 1, 2 HAVING count(*) >= ceil(0.01 * {_N})""")


@query("M5_level2_scan", "a b support! mean_r# win_rate# lift#4 ic#", f"""
SELECT p.*, mean_r / m AS lift, (s / n - (support / n) * m) / (sqrt(support / n - pow(support / n, 2)) * sqrt(q / n - m * m)) AS ic FROM mpair p, (SELECT count(*)::DOUBLE AS n, avg(net_r) AS m, sum(net_r * net_r) AS q FROM mcond) t""")
def _(spark, d):
    return M.level2_scan(conditioned(spark, d), "net_r")


@query("M6_level3_scan", "a b third support! mean_r# improvement#", f"""
SELECT a, b, third, count(*) AS support, avg(net_r) AS mean_r, avg(net_r) - max(base) AS improvement FROM (
SELECT p.a, p.b, e.c AS third, x.net_r, p.mean_r AS base FROM mpair p JOIN mcond x ON list_contains(x.conds, p.a) AND list_contains(x.conds, p.b) JOIN mex e ON e.order_id = x.order_id AND e.c <> p.a AND e.c <> p.b)
GROUP BY 1, 2, 3 HAVING count(*) >= ceil(0.01 * {_N}) AND avg(net_r) > max(base) + 1e-10""")
def _(spark, d):
    x = conditioned(spark, d)
    return M.level3_scan(x, M.level2_scan(x, "net_r"), "net_r")


def _beam_sql(k):
    """The best twenty rules of k conditions: each of the best of k - 1 with one more, or single conditions."""
    if k == 1:
        rules = f"SELECT [c] AS rule, avg(net_r) AS score, count(*) AS support FROM mex GROUP BY c HAVING count(*) >= ceil(0.01 * {_N})"
    else:
        rules = f"""SELECT rule, max(support) AS support, arg_max(score, parent) AS score FROM (
SELECT list_sort(list_append(p.rule, e.c)) AS rule, p.score AS parent, count(*) AS support, avg(x.net_r) AS score FROM mbeam{k - 1} p JOIN mcond x ON list_has_all(x.conds, p.rule) JOIN mex e USING (order_id)
WHERE NOT list_contains(p.rule, e.c) AND NOT EXISTS (SELECT 1 FROM mnear z WHERE z.a = e.c AND list_contains(p.rule, z.b)) GROUP BY p.rule, p.score, e.c)
GROUP BY rule HAVING max(support) >= ceil(0.01 * {_N}) AND arg_max(score, parent) > max(parent) + 1e-10"""
    return f"SELECT * FROM ({rules}) ORDER BY round(score, 10) DESC, support DESC, array_to_string(rule, '|') LIMIT 20"


cte("mnear", f"""
SELECT a, b FROM (SELECT x.c AS a, y.c AS b, count(*) AS n FROM mex x JOIN mex y ON x.order_id = y.order_id AND x.c <> y.c GROUP BY 1, 2) p
JOIN (SELECT c AS a, count(*)::DOUBLE AS na FROM mex GROUP BY 1) USING (a) JOIN (SELECT c AS b, count(*)::DOUBLE AS nb FROM mex GROUP BY 1) USING (b)
WHERE (n * {_N} - na * nb) / nullif(sqrt(na * ({_N} - na)) * sqrt(nb * ({_N} - nb)), 0) > 0.95""")
for _k in (1, 2, 3):
    cte(f"mbeam{_k}", _beam_sql(_k))


@query("M6_beam_search", "rule score# support! depth!", "SELECT array_to_string(rule, ',') AS rule, score, support, len(rule) AS depth FROM (" + " UNION ALL ".join(
    f"SELECT rule, score, support FROM mbeam{k}" for k in (1, 2, 3)) + ")")
def _(spark, d):
    return M.beam_search(conditioned(spark, d), "net_r", beam=20).withColumn("rule", F.array_join("rule", ","))


def pair_rules(x):
    """Every supported pair as a rule."""
    return cut_lineage(M.level2_scan(x, "net_r").select(F.concat_ws("&", "a", "b").alias("rule_id"), F.array("a", "b").alias("rule")))


cte("mrules", "SELECT concat_ws('&', a, b) AS rule_id, a, b FROM mpair")
cte("mhit", "SELECT r.rule_id, x.* FROM mrules r JOIN mcond x ON list_contains(x.conds, r.a) AND list_contains(x.conds, r.b)")
cte("mscore", f"""
SELECT g.*, s.symbol_cv, z.regime_cv, mean_r / {_TM} AS lift, mean_r - 0.05 AS fee_2x, mean_r - 0.2 AS fee_5x FROM (SELECT rule_id, count(*) AS n, avg(net_r) AS mean_r, median(net_r) AS median_r, stddev_pop(net_r) AS std_r, avg(CASE WHEN net_r > 0 THEN 1.0 ELSE 0 END) AS positive_rate,
  sum(greatest(net_r, 0)) / nullif(abs(sum(least(net_r, 0))), 0) AS profit_factor, avg(net_r) / stddev_pop(net_r) * sqrt(count(*)::DOUBLE) AS sharpe FROM mhit GROUP BY 1) g
JOIN (SELECT rule_id, stddev_pop(m) / abs(avg(m)) AS symbol_cv FROM (SELECT rule_id, symbol, avg(net_r) AS m FROM mhit GROUP BY 1, 2) GROUP BY 1) s USING (rule_id) JOIN (SELECT rule_id, stddev_pop(m) / abs(avg(m)) AS regime_cv FROM (SELECT rule_id, regime, avg(net_r) AS m FROM mhit GROUP BY 1, 2) GROUP BY 1) z USING (rule_id)""")


@query("M7_score_rules", "rule_id n! mean_r# median_r# positive_rate# profit_factor# sharpe#4 symbol_cv#4 regime_cv#4 lift#4 fee_2x# fee_5x#", "SELECT * FROM mscore")
def _(spark, d):
    x = conditioned(spark, d)
    return M.score_rules(x, pair_rules(x), "net_r")


# the error-function approximation as SQL
_A = M._ERF


def cdf_sql(z):
    t = f"(1 / (1 + {M._ERF_P} * abs({z}) / sqrt(2.0::DOUBLE)))"
    poly = " + ".join(f"({a}::DOUBLE) * pow({t}, {i + 1})" for i, a in enumerate(_A))
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + 1 - ({poly}) * exp(-pow({z}, 2) / 2)) ELSE 0.5 * (1 - (1 - ({poly}) * exp(-pow({z}, 2) / 2))) END)"


def ppf_sql(p):
    def poly(coef, x):
        out = f"({coef[0]})::DOUBLE"
        for a in coef[1:]:
            out = f"({out} * {x} + ({a}))"
        return out
    low, q = f"least({p}, 1 - ({p}))", f"(({p}) - 0.5)"
    t = f"sqrt(-2 * ln({low}))"
    tail = f"({poly(M._PPF_C, t)} / {poly(M._PPF_D, t)})"
    return f"(CASE WHEN {low} >= {M._PPF_TAIL} THEN {poly(M._PPF_A, f'({q} * {q})')} * {q} / {poly(M._PPF_B, f'({q} * {q})')} WHEN {q} < 0 THEN {tail} ELSE -{tail} END)"


@query("M8_multiple_testing", "rule_id p_value#5 bonferroni? bh? adjusted_p#5 deflated_sharpe#4", f"""
SELECT *, p_value <= 0.05 / m AS bonferroni, coalesce(rank <= max(CASE WHEN p_value <= rank / m * 0.05 THEN rank END) OVER (), false) AS bh, least(1, p_value * m / rank) AS adjusted_p, sharpe * sqrt((n - 1) / n) - {ppf_sql('1 - 0.5 / m')} / sqrt(n) AS deflated_sharpe FROM (
SELECT *, row_number() OVER (ORDER BY p_value, rule_id) AS rank, count(*) OVER ()::DOUBLE AS m FROM (SELECT rule_id, n::DOUBLE AS n, sharpe, 2 * (1 - {cdf_sql('zz')}) AS p_value FROM (SELECT *, abs(mean_r * sqrt(n::DOUBLE) / std_r) AS zz FROM mscore)))""")
def _(spark, d):
    x = conditioned(spark, d)
    r = M.correct(M.p_values(M.score_rules(x, pair_rules(x), "net_r")))
    return r.withColumn("deflated_sharpe", M.deflated_sharpe("sharpe", "n", "m"))


cte("mreach", """
SELECT rule_id AS a, rule_id AS b FROM mrules UNION
SELECT r.a, e.b FROM mreach r JOIN (SELECT a, b FROM msim WHERE similarity >= 0.5 UNION ALL SELECT b, a FROM msim WHERE similarity >= 0.5) e ON r.b = e.a""")
cte("msim", """
SELECT a, b, nab / u AS jaccard, c AS corr, 0.6 * nab / u + 0.4 * abs(c) AS similarity FROM (SELECT *, (qab / u - sa / u * sb / u) / (sqrt(qa / u - pow(sa / u, 2)) * sqrt(qb / u - pow(sb / u, 2))) AS c FROM (
SELECT p.a, p.b, p.nab::DOUBLE AS nab, p.qab, (x.n + y.n - p.nab)::DOUBLE AS u, x.s AS sa, x.q AS qa, y.s AS sb, y.q AS qb FROM (SELECT g.rule_id AS a, h.rule_id AS b, count(*) AS nab, sum(g.net_r * g.net_r) AS qab FROM mhit g JOIN mhit h ON g.order_id = h.order_id AND g.rule_id < h.rule_id GROUP BY 1, 2) p
JOIN (SELECT rule_id, count(*) AS n, sum(net_r) AS s, sum(net_r * net_r) AS q FROM mhit GROUP BY 1) x ON x.rule_id = p.a JOIN (SELECT rule_id, count(*) AS n, sum(net_r) AS s, sum(net_r * net_r) AS q FROM mhit GROUP BY 1) y ON y.rule_id = p.b))""")


@query("M9_rule_similarity", "a b jaccard# corr#5 similarity#5", "SELECT * FROM msim")
def _(spark, d):
    x = conditioned(spark, d)
    return M.rule_similarity(x, pair_rules(x), "net_r")


@query("M9_dedupe_rules", "rule_id family mean_r# is_representative?", """
SELECT rule_id, family, mean_r, row_number() OVER (PARTITION BY family ORDER BY round(mean_r, 10) DESC, rule_id) = 1 AS is_representative
FROM mscore JOIN (SELECT a AS rule_id, min(b) AS family FROM mreach GROUP BY 1) USING (rule_id)""")
def _(spark, d):
    x = conditioned(spark, d)
    r = pair_rules(x)
    return M.dedupe_rules(cut_lineage(M.score_rules(x, r, "net_r")), cut_lineage(M.rule_similarity(x, r, "net_r")), 0.5)


@query("M10_validate_rules_oos", "rule_id n_discovery! n_validation! n_holdout! mean_discovery# mean_validation# mean_holdout# oos_is_ratio#4 sign_ok? status", """
SELECT *, mean_validation / nullif(mean_discovery, 0) AS oos_is_ratio, sign(mean_discovery) = sign(mean_validation) AS sign_ok, CASE WHEN mean_validation / nullif(mean_discovery, 0) < 0.5 THEN 'REJECTED' ELSE 'VALIDATED' END AS status FROM (
SELECT rule_id, count(*) FILTER (WHERE split = 'discovery') AS n_discovery, count(*) FILTER (WHERE split = 'validation') AS n_validation, count(*) FILTER (WHERE split = 'holdout') AS n_holdout, avg(net_r) FILTER (WHERE split = 'discovery') AS mean_discovery, avg(net_r) FILTER (WHERE split = 'validation') AS mean_validation, avg(net_r) FILTER (WHERE split = 'holdout') AS mean_holdout
FROM (SELECT h.*, CASE WHEN i < floor(n * 0.6) THEN 'discovery' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'holdout' END AS split FROM mhit h JOIN (SELECT order_id, row_number() OVER (ORDER BY closed_at, order_id) - 1 AS i, count(*) OVER () AS n FROM mcond) USING (order_id)) GROUP BY 1)""")
def _(spark, d):
    x = conditioned(spark, d)
    return M.validate_rules_oos(SP.temporal_split(x, ["closed_at", "order_id"]), pair_rules(x), "net_r")

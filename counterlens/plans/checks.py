"""SQL of the checking engine for queries whose own form is not SQL, written from their definitions."""

from __future__ import annotations

from counterlens.plans.oracle import with_base


def tail(n: str, k: str, rate: str) -> str:
    """P(X <= k) as a plain sum of masses."""
    return f"list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1e0) - lgamma(i + 1e0) - lgamma({n} - i + 1e0) + i * ln({rate}) + ({n} - i) * ln(1e0 - {rate}))))"


ALPHA = "0.45e0"
POOL = """pool AS (SELECT variant, u, CASE WHEN own = label THEN 0 ELSE 1 END AS wrong FROM preds WHERE split = 'calib' AND NOT gate_fired AND u IS NOT NULL)"""
CELLS = f"""{POOL}, d AS (SELECT variant, u, count(*) AS m, sum(wrong) AS w FROM pool GROUP BY variant, u),
  cells AS (SELECT variant, u, CAST(sum(m) OVER (PARTITION BY variant ORDER BY u) AS BIGINT) AS n, CAST(sum(w) OVER (PARTITION BY variant ORDER BY u) AS BIGINT) AS k FROM d),
  best AS (SELECT variant, max(u) AS tau, max(n) AS retained FROM cells WHERE k < n AND {tail('n', 'k', ALPHA)} <= 0.1e0 GROUP BY variant)"""
MCNEMAR = f"""b AS (SELECT item_no, correct FROM preds WHERE variant = 'base'), c AS (SELECT p.variant, count(CASE WHEN NOT b.correct AND p.correct THEN 1 END) AS b01, count(CASE WHEN b.correct AND NOT p.correct THEN 1 END) AS b10 FROM preds p JOIN b ON b.item_no = p.item_no WHERE p.variant <> 'base' GROUP BY p.variant),
  t AS (SELECT *, CASE WHEN b01 + b10 = 0 THEN 1e0 ELSE least(1e0, 2e0 * {tail('(b01 + b10)', 'least(b01, b10)', '0.5e0')}) END AS p FROM c)"""
RATED = """ratings AS (SELECT doc_id, 'r1' AS rater, 1 + quality + doc_id % 3 AS value FROM labels UNION ALL SELECT doc_id, 'r2', 1 + quality + CASE WHEN doc_id % 4 = 0 THEN (doc_id + 1) % 3 ELSE doc_id % 3 END FROM labels
  UNION ALL SELECT doc_id, 'r3', CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1 + quality + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE doc_id % 3 END END FROM labels)"""
DRAW = "CAST('0x' || substr(md5({x}), 1, 7) AS BIGINT) % 1000003"

_WRONG = "CAST(sum(CASE WHEN own = label THEN 0 ELSE 1 END) AS BIGINT) AS k"
ERRORS = f"g AS (SELECT n, k FROM (SELECT count(*) AS n, {_WRONG} FROM preds GROUP BY variant, family, split UNION SELECT count(*), {_WRONG} FROM preds GROUP BY variant, sid UNION SELECT count(*), {_WRONG} FROM preds GROUP BY variant) AS x WHERE k < n)"

SQL = {
    "a17_aurc_prefixes": """WITH r AS (SELECT variant, avg(CASE WHEN own = label THEN 0e0 ELSE 1e0 END) OVER (PARTITION BY variant ORDER BY u, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM preds WHERE u IS NOT NULL) SELECT variant, round(avg(risk), 9) AS aurc FROM r GROUP BY variant""",
    "a19_fraction_grid": """WITH r AS (SELECT variant, row_number() OVER w AS rn, count(*) OVER (PARTITION BY variant) AS n, avg(CASE WHEN own = label THEN 0e0 ELSE 1e0 END) OVER (PARTITION BY variant ORDER BY u, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM preds WHERE u IS NOT NULL WINDOW w AS (PARTITION BY variant ORDER BY u, item_no))
  SELECT variant, tenth, rn AS kept, round(risk, 9) AS risk FROM r JOIN range(1, 11) AS g(tenth) ON rn = greatest(1, CAST(round_even(tenth * n / 10e0, 0) AS BIGINT))""",
    "a47_intra_rater": f"""WITH {RATED}, p AS (SELECT a.rater, a.value = b.value AS same FROM ratings a JOIN ratings b ON a.rater = b.rater AND a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1 AND a.value IS NOT NULL AND b.value IS NOT NULL),
  f AS (SELECT doc_id // 10 AS feature, avg(CASE WHEN value >= 3 THEN 1e0 ELSE 0e0 END) AS accepted FROM ratings WHERE value IS NOT NULL GROUP BY 1), s AS (SELECT count(*) AS features, round(avg(accepted), 9) AS mean_accepted, round(avg(CASE WHEN accepted >= 0.5 THEN 1e0 ELSE 0e0 END), 9) AS pass_rate, avg(CASE WHEN accepted >= 0.5 THEN 1e0 ELSE 0e0 END) < 0.3 AS fallback FROM f)
  SELECT rater, count(*) AS repeats, round(avg(CASE WHEN same THEN 1e0 ELSE 0e0 END), 9) AS agreement, any_value(s.features) AS features, any_value(s.mean_accepted) AS mean_accepted, any_value(s.pass_rate) AS pass_rate, any_value(s.fallback) AS fallback FROM p CROSS JOIN s GROUP BY rater""",
    "a49_answer_census": """SELECT variant, split, count(*) AS n, round(avg(CASE WHEN own IS NULL THEN 1e0 ELSE 0e0 END), 9) AS non_answer, count(*) FILTER (WHERE own IS NOT NULL AND logit_margin <> 0) AS with_margin, count(*) FILTER (WHERE own = 'SAFE' AND logit_margin > 0 OR own = 'UNSAFE' AND logit_margin < 0) AS agree,
  count(*) FILTER (WHERE own IS NOT NULL AND logit_margin <> 0 AND u IS NOT NULL) AS recomputed, count(*) FILTER (WHERE own IS NOT NULL AND logit_margin <> 0 AND abs(u - (ln(1e0 + exp(-abs(logit_margin))) + abs(logit_margin) / (1e0 + exp(abs(logit_margin))))) < 1e-6) AS recomputed_equal,
  count(*) FILTER (WHERE own IS NOT NULL AND logit_margin IS NULL) AS no_margin, count(*) FILTER (WHERE own IS NOT NULL AND logit_margin IS NULL AND abstained AND NOT gate_fired) AS deferred_for_it FROM preds GROUP BY variant, split""",
    "u01_binomial_tail": f"WITH {ERRORS} SELECT n, k, round({tail('n', 'k', '0.4e0')}, 9) AS tail, round({tail('n', 'k', '0.4e0')}, 9) <= 0.1e0 AS certifies FROM g",
    "u01_upper_limits": f"WITH {ERRORS} SELECT n, k, 0.1e0 AS chance, TRUE AS above FROM g",
    "u02_min_certifiable_n": "WITH c AS (SELECT variant, family, count(*) AS rows FROM preds WHERE split = 'calib' GROUP BY 1, 2) SELECT variant, family, alpha, delta, least, rows >= least AS enough FROM c CROSS JOIN (SELECT a.x AS alpha, d.x AS delta, (SELECT min(i) FROM range(1, 200) AS r(i) WHERE pow(1 - a.x, i) <= d.x + 1e-15) AS least FROM (VALUES (0.2e0), (0.1e0), (0.05e0)) AS a(x), (VALUES (0.2e0), (0.1e0), (0.05e0)) AS d(x)) AS q",
    "u03_conformal_threshold": f"""WITH {CELLS} SELECT v.variant, b.tau, coalesce(b.retained, 0) AS retained, b.tau IS NOT NULL AS certifiable FROM variants v LEFT JOIN best b ON b.variant = v.variant""",
    "u05_calibration_diagnostics": f"""WITH {CELLS} SELECT p.variant, count(*) AS n, count(*) FILTER (WHERE p.u <= b.tau) AS retained, CAST(coalesce(sum(wrong) FILTER (WHERE p.u <= b.tau), 0) AS BIGINT) AS errors, round(count(*) FILTER (WHERE p.u <= b.tau) / CAST(count(*) AS DOUBLE), 9) AS coverage, round(avg(CASE WHEN p.u <= b.tau THEN CAST(p.wrong AS DOUBLE) END), 9) AS selective_error, bool_or(b.tau IS NOT NULL) AS certifiable FROM pool p LEFT JOIN best b ON b.variant = p.variant GROUP BY p.variant""",
    "u06_bootstrap_interval": """WITH g AS (SELECT variant, count(*) AS n, count(CASE WHEN correct THEN 1 END) AS k FROM preds GROUP BY variant), m AS (SELECT variant, n, i, exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) + i * ln(k / CAST(n AS DOUBLE)) + (n - i) * ln(1e0 - k / CAST(n AS DOUBLE))) AS p FROM g, LATERAL unnest(range(0, n + 1)) AS x(i)),
  c AS (SELECT variant, n, i, sum(p) OVER (PARTITION BY variant ORDER BY i) AS c FROM m) SELECT variant, round(min(CASE WHEN c >= 0.025e0 THEN i END) / CAST(max(n) AS DOUBLE), 9) AS lo, round(min(CASE WHEN c >= 0.975e0 THEN i END) / CAST(max(n) AS DOUBLE), 9) AS hi FROM c GROUP BY variant""",
    "u11_mcnemar": f"WITH {MCNEMAR} SELECT variant, b01, b10, round(p, 9) AS p_value FROM t",
    "u12_holm": f"""WITH {MCNEMAR}, r AS (SELECT variant, round(p, 12) AS p, row_number() OVER (ORDER BY round(p, 12), variant) AS i, count(*) OVER () AS m FROM t) SELECT variant, round(p, 9) AS p, round(least(1e0, max((m - i + 1) * p) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_holm FROM r""",
    "u19_grouped_folds": f"""SELECT pair_id, (row_number() OVER (ORDER BY {DRAW.format(x='pair_id')}, pair_id) - 1) % 5 AS fold_no FROM (SELECT DISTINCT pair_id FROM items) AS p""",
    "w03_running_errors": "SELECT variant, item_no, CAST(sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (PARTITION BY variant ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS errors FROM preds",
    "w06_prefix_mean": "SELECT variant, item_no, round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY variant ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS m FROM preds",
    "x02_variant_run": f"""WITH pool AS (SELECT variant, u, coalesce(pred = label, FALSE) AS ok FROM preds WHERE uq AND split = 'calib' AND NOT gate_fired AND u IS NOT NULL), d AS (SELECT variant, u, count(*) AS m, count(CASE WHEN NOT ok THEN 1 END) AS w FROM pool GROUP BY variant, u),
  c AS (SELECT variant, u, sum(m) OVER (PARTITION BY variant ORDER BY u) AS n, sum(w) OVER (PARTITION BY variant ORDER BY u) AS k FROM d), best AS (SELECT variant, max(u) AS tau FROM c WHERE k < n AND {tail('n', 'k', ALPHA)} <= 0.1e0 GROUP BY variant)
  SELECT p.variant, p.id, p.pred, p.gate_fired, b.tau, p.uq AND NOT p.gate_fired AND (p.pred IS NULL OR p.u IS NULL OR NOT coalesce(p.u <= b.tau, FALSE)) AS abstained FROM preds p LEFT JOIN best b ON b.variant = p.variant WHERE p.split = 'test'""",
}
ORACLE_SQL = {name: with_base(text) for name, text in SQL.items()}

"""SQL of the checking engine for effects, sweeps, pointing, matched controls and pair metrics.

Written from the definitions, row by row where the operators aggregate: a control's place is
a rank over all other features, a neighbour is found by counting those between.
"""

from __future__ import annotations

from counterlens.plans.oracle import with_base

EFFECTS = """eff AS (SELECT i.pair_id, l.i AS layer, a.alpha, (i.h % 200 - 100) / 50e0 * a.alpha + l.i / 10e0 AS delta, (i.h % 90 - 45) / 60e0 AS control, (i.h % 50 - 25) / 70e0 AS shuffled, (i.h % 300 - 120) / 80e0 AS gap
  FROM (SELECT pair_id, min(item_no) * 2654435761 % 1000003 AS h FROM items WHERE NOT is_control GROUP BY pair_id) AS i CROSS JOIN range(0, 6) AS l(i) CROSS JOIN (VALUES (-1e0), (-0.5e0), (0.5e0), (1e0)) AS a(alpha))"""
SWEEP = """swept AS (SELECT r.run, l.i AS layer, a.alpha, pair_id, label, (h % 200 - 100) / 50e0 + a.alpha * (l.i - 1) * CASE WHEN label = 'SAFE' THEN 0.5e0 ELSE -0.5e0 END AS m, (h % 200 - 100) / 50e0 + a.alpha * (h % 7 - 3) / 4e0 AS r
  FROM (SELECT *, item_no * 2654435761 % 1000003 AS h FROM items WHERE NOT is_control) AS i CROSS JOIN range(0, 5) AS l(i) CROSS JOIN (VALUES (-1e0), (-0.5e0), (0e0), (0.5e0), (1e0)) AS a(alpha) CROSS JOIN (VALUES ('baseline'), ('rerun')) AS r(run) WHERE run = 'rerun' OR alpha <= 0),
  sarm AS (SELECT run, layer, alpha, pair_id, bool_and((m > 0) = (label = 'SAFE')) AS ok, bool_and((r > 0) = (label = 'SAFE')) AS ok_rand FROM swept GROUP BY ALL),
  cells AS (SELECT run, layer, alpha, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS cc, avg(CASE WHEN ok_rand THEN 1e0 ELSE 0e0 END) AS cc_rand FROM sarm GROUP BY ALL), gains AS (SELECT *, round(cc - cc_rand, 12) AS gain FROM cells)"""
SHARE = "avg(CASE WHEN {0} THEN 1e0 ELSE 0e0 END)"
TOKENS = """token AS (SELECT e.user_id AS item, ['view', 'click', 'signup', 'error'][f.i % 4 + 1] AS concept, 0.1e0 + (e.event_id * (f.i + 3) * 31 % 101) / 50e0 AS x FROM events e CROSS JOIN range(0, 12) AS f(i) WHERE (e.event_id * (f.i + 7) * 2654435761) % 1000003 % (4 + f.i) = 0),
  want AS (SELECT family, concept FROM (VALUES (0, 'view'), (0, 'click'), (1, 'purchase'), (2, 'signup'), (2, 'purchase')) AS w(family, concept)),
  item AS (SELECT user_id AS item, user_id % 4 AS family, list(DISTINCT event_type) AS there FROM events GROUP BY 1, 2),
  asked AS (SELECT i.item, i.there, list(w.concept) AS wanted FROM item i JOIN want w ON w.family = i.family GROUP BY 1, 2),
  top_sum AS (SELECT item, concept FROM (SELECT item, concept, round(sum(x), 12) AS s FROM token GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY item ORDER BY s DESC, concept) = 1),
  top_mean AS (SELECT item, concept FROM (SELECT item, concept, round(avg(x), 12) AS s FROM token GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY item ORDER BY s DESC, concept) = 1),
  judged AS (SELECT a.item, list_has_any(wanted, ['view', 'click', 'signup', 'error']) AS can, coalesce(list_contains(wanted, s.concept), FALSE) AS by_sum, coalesce(list_contains(wanted, m.concept), FALSE) AS by_mean, len(list_intersect(wanted, there)) / CAST(len(there) AS DOUBLE) AS guess
    FROM asked a LEFT JOIN top_sum s ON s.item = a.item LEFT JOIN top_mean m ON m.item = a.item)"""
GROUPS = " UNION ALL ".join(f"SELECT variant, '{a}={{}}' AS attribute, CAST({a} AS VARCHAR) AS grp, abstained FROM preds" for a in ("family", "label", "presentation", "gate_fired"))

SQL = {
    "a11_coverage_gap": f"WITH g AS ({GROUPS}), c AS (SELECT variant, attribute, grp, {SHARE.format('NOT abstained')} AS coverage FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 5) SELECT variant, round(min(coverage), 9) AS lowest, round(max(coverage), 9) AS highest, round(max(coverage) - min(coverage), 9) AS gap FROM c GROUP BY variant",
    "a12_grouped_pooled": f"""WITH p AS (SELECT a.variant, a.family, coalesce(a.is_control, FALSE) AS ctrl, a.pred IS NOT DISTINCT FROM a.label AND b.pred IS NOT DISTINCT FROM b.label AS ok, coalesce(a.pred <> b.pred, FALSE) AS flipped FROM preds a JOIN preds b ON a.variant = b.variant AND a.pair_id = b.pair_id AND a.id < b.id),
  u AS (SELECT * FROM p UNION ALL SELECT variant, 'POOLED', ctrl, ok, flipped FROM p) SELECT variant, ctrl, family, count(*) AS n, round({SHARE.format('ok')}, 9) AS consistency, round({SHARE.format('flipped')}, 9) AS flip_rate FROM u GROUP BY 1, 2, 3""",
    "a13_constant_baseline": """WITH n AS (SELECT variant, count(*) AS n FROM preds GROUP BY 1), l AS (SELECT variant, label, count(*) AS k FROM preds GROUP BY 1, 2), r AS (SELECT variant, pred, count(*) AS k FROM preds GROUP BY 1, 2),
  g AS (SELECT variant, label, k FROM l QUALIFY row_number() OVER (PARTITION BY variant ORDER BY k DESC, label) = 1), m AS (SELECT variant, pred, k FROM r QUALIFY row_number() OVER (PARTITION BY variant ORDER BY k DESC, pred NULLS LAST) = 1)
  SELECT n.variant, g.label AS answer, round(g.k / CAST(n.n AS DOUBLE), 9) AS baseline_accuracy, m.pred AS response, round(m.k / CAST(n.n AS DOUBLE), 9) AS response_bias, round(coalesce(l.k, 0) / CAST(n.n AS DOUBLE), 9) AS response_gold FROM n JOIN g USING (variant) JOIN m USING (variant) LEFT JOIN l ON l.variant = n.variant AND l.label = m.pred""",
    "a21_point_at_tau": f"""WITH o AS (SELECT variant, coalesce(u, CAST('Infinity' AS DOUBLE)) AS u, own IS DISTINCT FROM label AS wrong FROM preds WHERE NOT gate_fired), v AS (SELECT DISTINCT variant, tau FROM preds CROSS JOIN (VALUES (0.5e0), (-1e0), (CAST('-Infinity' AS DOUBLE))) AS t(tau)),
  k AS (SELECT v.variant, v.tau, count(*) FILTER (WHERE o.u <= v.tau) AS kept, count(*) FILTER (WHERE o.u <= v.tau) / CAST(count(*) AS DOUBLE) AS coverage, avg(CASE WHEN o.u <= v.tau THEN CASE WHEN wrong THEN 1e0 ELSE 0e0 END END) AS error FROM v JOIN o ON o.variant = v.variant GROUP BY 1, 2)
  SELECT variant, CASE WHEN isfinite(tau) THEN tau END AS tau, CASE WHEN NOT isfinite(tau) THEN 'none' WHEN kept = 0 THEN 'below' ELSE 'on' END AS state, kept, round(coverage, 9) AS coverage, round(error, 9) AS error FROM k""",
    "a35_layer_effect": f"WITH {EFFECTS}, g AS (SELECT avg(gap) AS gap FROM (SELECT DISTINCT pair_id, gap FROM eff)) SELECT layer, round(avg(delta), 9) AS ace, round(avg(control), 9) AS control, round(avg(delta - control), 9) AS excess, CASE WHEN abs(any_value(g.gap)) >= 0.1e0 THEN round(avg(delta) / any_value(g.gap), 9) END AS normalised FROM eff, g WHERE alpha = 1 GROUP BY layer",
    "a36_dose_response": f"""WITH {EFFECTS}, c AS (SELECT layer, alpha, count(*) AS n, round(avg(delta), 12) AS ace, avg(delta - control) AS excess, avg(shuffled) AS sh FROM eff GROUP BY 1, 2),
  m AS (SELECT a.layer, bool_and(a.ace <= b.ace) OR bool_and(a.ace >= b.ace) AS monotone FROM c a JOIN c b ON a.layer = b.layer AND a.alpha < b.alpha GROUP BY 1), b AS (SELECT layer, alpha AS best_alpha, excess AS best_excess FROM c QUALIFY row_number() OVER (PARTITION BY layer ORDER BY round(abs(excess), 12) DESC, alpha) = 1)
  SELECT m.layer, m.monotone, b.best_alpha, round(b.best_excess, 9) AS best_excess, (SELECT round(avg(sh), 9) FROM c WHERE c.layer = m.layer) AS shuffled_control, (SELECT min(n) FROM c WHERE c.layer = m.layer) AS n FROM m JOIN b ON b.layer = m.layer""",
    "a37_best_cell": f"""WITH {SWEEP}, b AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY run ORDER BY gain DESC, layer, alpha) = 1),
  beside AS (SELECT b.run, g.gain >= 0.5e0 * b.gain AS holds FROM b JOIN gains g ON g.run = b.run AND g.layer = b.layer AND sign(g.alpha) = sign(b.alpha) AND g.alpha <> b.alpha AND b.alpha <> 0
    WHERE NOT EXISTS (SELECT 1 FROM gains x WHERE x.run = b.run AND x.layer = b.layer AND sign(x.alpha) = sign(b.alpha) AND abs(x.alpha) > least(abs(g.alpha), abs(b.alpha)) AND abs(x.alpha) < greatest(abs(g.alpha), abs(b.alpha))))
  SELECT b.run, (SELECT count(*) FROM gains g WHERE g.run = b.run) AS cells, layer, alpha, round(cc, 9) AS cc, round(cc_rand, 9) AS cc_rand, round(gain, 9) AS gain, (SELECT round(arg_min(cc, layer), 9) FROM gains g WHERE g.run = b.run AND alpha = 0) AS base,
    (SELECT round(max(abs(cc_rand)), 9) FROM gains g WHERE g.run = b.run) AS control_swing, coalesce((SELECT bool_and(holds) FROM beside WHERE beside.run = b.run), FALSE) AS dose_response FROM b""",
    "a41_edit_percentile": """WITH w AS (SELECT pair_id, arm, item_no, string_split(prompt, ' ') AS w FROM items), c AS (SELECT a.pair_id, a.w AS x, b.w AS y, a.item_no FROM w a JOIN w b ON a.pair_id = b.pair_id AND a.arm = 'safe' AND b.arm = 'unsafe' AND len(a.w) = len(b.w)),
  s AS (SELECT pair_id, x, y, least(6, len(x)) AS n, list_transform(range(0, least(6, len(x))), lambda i: (item_no * 31 + i * 97531) % 1009 * 100 + i) AS v FROM c), d AS (SELECT *, unnest(range(0, n)) AS i FROM s)
  SELECT pair_id, round(avg(len(list_filter(v, lambda z: z < v[i + 1])) / CAST(greatest(1, n - 1) AS DOUBLE)), 9) AS percentile, count(*) AS n FROM d WHERE x[i + 1] <> y[i + 1] GROUP BY pair_id""",
    "a42_pointing": f"WITH {TOKENS} SELECT count(*) AS n, count(*) FILTER (WHERE NOT can) AS n_inexpressible, round({SHARE.format('by_sum')}, 9) AS accuracy_sum, round({SHARE.format('by_mean')}, 9) AS accuracy_mean, round(avg(CASE WHEN can THEN CASE WHEN by_sum THEN 1e0 ELSE 0e0 END END), 9) AS expressible_sum, round(avg(CASE WHEN can THEN CASE WHEN by_mean THEN 1e0 ELSE 0e0 END END), 9) AS expressible_mean, round(avg(guess), 9) AS random_accuracy FROM judged",
    "a53_signed_best": f"""WITH {SWEEP}, a AS (SELECT *, 'all' AS arm FROM gains UNION ALL SELECT *, CASE WHEN alpha > 0 THEN 'positive' ELSE 'negative' END FROM gains WHERE alpha <> 0)
  SELECT run, arm, count(*) OVER w AS cells, min(alpha) OVER w AS lowest, max(alpha) OVER w AS highest, layer, alpha, round(cc, 9) AS cc, round(cc_rand, 9) AS cc_rand, round(gain, 9) AS gain FROM a WINDOW w AS (PARTITION BY run, arm) QUALIFY row_number() OVER (PARTITION BY run, arm ORDER BY gain DESC, layer, alpha) = 1""",
    "x01_dedup_fanout": """WITH d AS (SELECT prompt, length(prompt) AS length, (row_number() OVER (PARTITION BY length(prompt) ORDER BY prompt) - 1) // 8 AS batch, len(regexp_extract_all(prompt, '[0-9]')) AS digits, CAST('0x' || substr(md5(prompt), 1, 7) AS BIGINT) AS checksum FROM (SELECT DISTINCT prompt FROM items) AS x)
  SELECT i.id, d.length, d.batch, d.digits, d.checksum FROM items i JOIN d ON d.prompt = i.prompt""",
    "j17_matched_controls": """WITH f AS (SELECT event_type || '_' || CAST(user_id % 20 AS VARCHAR) AS feature, count(*) AS n FROM events GROUP BY 1),
  c AS (SELECT a.feature, b.feature AS control, round(abs(ln(b.n + 1e0) - ln(a.n + 1e0)), 12) AS gap, CAST('0x' || substr(md5('0|' || a.feature || '|' || b.feature), 1, 7) AS BIGINT) % 1000003 AS draw FROM f a JOIN f b ON a.feature <> b.feature),
  p AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gap, control) AS place FROM c QUALIFY place <= 50) SELECT feature, control, place, round(gap, 9) AS log_ratio, row_number() OVER (PARTITION BY feature ORDER BY draw, control) <= 5 AS drawn FROM p""",
}
ORACLE_SQL = {name: with_base(text) for name, text in SQL.items()}

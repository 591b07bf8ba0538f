"""Feature, effect and agreement plans in SQL; they check the functions of feature_scores and agreement."""

from __future__ import annotations

from counterlens.plans.registry import plan, rate

# activations: a row's feature fires if its hashed value is small; concepts are event types
ACT = """act AS (SELECT e.event_id, f.i AS feature, e.event_type AS concept, 0.1e0 + (e.event_id * (f.i + 3) * 31 % 101) / 50e0 AS x FROM events e CROSS JOIN range(0, 12) AS f(i) WHERE (e.event_id * (f.i + 7) * 2654435761) % 1000003 % (4 + f.i) = 0),
  tp AS (SELECT feature, concept, count(*) AS tp FROM act GROUP BY feature, concept), fa AS (SELECT feature, count(*) AS n_active FROM act GROUP BY feature), cp AS (SELECT event_type AS concept, count(*) AS n_pos FROM events GROUP BY event_type),
  f1 AS (SELECT t.feature, t.concept, 2e0 * t.tp / (f.n_active + c.n_pos) AS f1 FROM tp t JOIN fa f ON f.feature = t.feature JOIN cp c ON c.concept = t.concept)"""
EFFECTS = """eff AS (SELECT i.pair_id, l.i AS layer, a.alpha, (i.h % 200 - 100) / 50e0 * a.alpha + l.i / 10e0 AS delta, (i.h % 90 - 45) / 60e0 AS control FROM (SELECT pair_id, min(item_no) * 2654435761 % 1000003 AS h FROM items WHERE NOT is_control GROUP BY pair_id) AS i CROSS JOIN range(0, 6) AS l(i) CROSS JOIN (VALUES (-1e0), (-0.5e0), (0.5e0), (1e0)) AS a(alpha))"""

plan("a31_feature_counts", f"WITH {ACT} SELECT t.feature, t.concept, t.tp, f.n_active, c.n_pos FROM tp t JOIN fa f ON f.feature = t.feature JOIN cp c ON c.concept = t.concept")
plan("a32_best_concept", f"WITH {ACT} SELECT feature, concept, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(f1, 12) DESC, concept) AS rn FROM f1) AS x WHERE rn = 1")
plan("a33_influence_score", f"WITH {ACT} SELECT feature, round(0.5e0 * max(f1) + 0.5e0 * greatest(0e0, least(1e0, 4e0 * (max(f1) - avg(f1)))), 9) AS score FROM f1 GROUP BY feature")
plan("a34_control_spread", f"WITH {ACT} SELECT concept, round(avg(f1), 9) AS mean, round(stddev_samp(f1), 9) AS sd, round(max(abs(ln(f1 / 0.1e0))), 9) AS worst FROM f1 GROUP BY concept")
plan("a44_index_quantile", "SELECT family, q AS p90 FROM (SELECT family, q, row_number() OVER (PARTITION BY family ORDER BY q) AS rn, count(*) OVER (PARTITION BY family) AS n FROM facts) AS x WHERE rn = CAST(floor(0.9e0 * (n - 1)) AS BIGINT) + 1")
# three raters over labelled documents; one rating in eleven is missing
RATINGS = """ratings AS (SELECT doc_id, 'r1' AS rater, 1 + quality + doc_id % 3 AS value FROM labels UNION ALL SELECT doc_id, 'r2', 1 + quality + CASE WHEN doc_id % 4 = 0 THEN (doc_id + 1) % 3 ELSE doc_id % 3 END FROM labels UNION ALL SELECT doc_id, 'r3', CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1 + quality + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE doc_id % 3 END END FROM labels)"""
COINC = f"""{RATINGS}, cnt AS (SELECT doc_id, value, count(*) AS n FROM ratings WHERE value IS NOT NULL GROUP BY doc_id, value), unit AS (SELECT doc_id, sum(n) AS m FROM cnt GROUP BY doc_id HAVING sum(n) >= 2),
  coin AS (SELECT a.value AS x, b.value AS y, sum(CAST(a.n * (b.n - CASE WHEN a.value = b.value THEN 1 ELSE 0 END) AS DOUBLE) / (u.m - 1)) AS o FROM cnt a JOIN cnt b ON b.doc_id = a.doc_id JOIN unit u ON u.doc_id = a.doc_id GROUP BY a.value, b.value), nc AS (SELECT x AS value, sum(o) AS n FROM coin GROUP BY x), cum AS (SELECT value, n, sum(n) OVER (ORDER BY value) AS c FROM nc), tot AS (SELECT sum(n) AS t FROM nc)"""
plan("a45_krippendorff_nominal", f"WITH {COINC} SELECT round(1e0 - (SELECT sum(CASE WHEN x <> y THEN o ELSE 0e0 END) FROM coin) / (SELECT t FROM tot) / ((SELECT sum(CASE WHEN a.value <> b.value THEN a.n * b.n ELSE 0e0 END) FROM nc a CROSS JOIN nc b) / ((SELECT t FROM tot) * ((SELECT t FROM tot) - 1))), 9) AS alpha")
plan("a45_krippendorff_ordinal", f"WITH {COINC}, dist AS (SELECT a.value AS x, b.value AS y, a.n * b.n AS nn, pow(abs(b.c - a.c) - abs(b.n - a.n) / 2e0 * CASE WHEN (b.c - a.c) * (b.n - a.n) > 0 THEN 1 ELSE -1 END, 2e0) AS d FROM cum a CROSS JOIN cum b WHERE a.value <> b.value) SELECT round(1e0 - ((SELECT sum(c.o * d.d) FROM coin c JOIN dist d ON d.x = c.x AND d.y = c.y) / (SELECT t FROM tot)) / ((SELECT sum(nn * d) FROM dist) / ((SELECT t FROM tot) * ((SELECT t FROM tot) - 1))), 9) AS alpha")
plan("a46_fleiss_kappa", f"WITH {COINC}, p AS (SELECT c.doc_id, CAST(sum(c.n * (c.n - 1)) AS DOUBLE) / (max(u.m) * (max(u.m) - 1)) AS p FROM cnt c JOIN unit u ON u.doc_id = c.doc_id GROUP BY c.doc_id), q AS (SELECT c.value, CAST(sum(c.n) AS DOUBLE) / (SELECT sum(m) FROM unit) AS pj FROM cnt c JOIN unit u ON u.doc_id = c.doc_id GROUP BY c.value) SELECT round(((SELECT avg(p) FROM p) - (SELECT sum(pj * pj) FROM q)) / (1e0 - (SELECT sum(pj * pj) FROM q)), 9) AS kappa")
plan("a48_contraction", f"WITH {EFFECTS} SELECT round(1e0 - sum(CASE WHEN alpha = 0.5e0 THEN greatest(delta, 0e0) ELSE 0e0 END) / sum(CASE WHEN alpha = 1e0 THEN greatest(delta, 0e0) ELSE 0e0 END), 9) AS contraction FROM eff")
plan("a51_pivot_delta", f"WITH m AS (SELECT variant, v, {rate('correct')} AS acc, {rate('NOT abstained')} AS cov FROM preds GROUP BY variant, v) SELECT m.variant, round(m.acc, 9) AS acc, round(m.cov, 9) AS cov, round(m.acc - b.acc, 9) AS d_acc, round(m.cov - b.cov, 9) AS d_cov FROM m JOIN m b ON b.variant = 'base'")
plan("a51_segment_pivot", "SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0e0 END), 2) AS open_qty, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0e0 END), 2) AS done_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag")

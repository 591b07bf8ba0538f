"""Uncertainty and window plans in SQL."""

from __future__ import annotations

from counterlens.plans.registry import plan, rate

plan(
    "u04_legacy_threshold",
    """WITH p AS (SELECT variant, u, item_no, CASE WHEN own = label THEN 0e0 ELSE 1e0 END AS wrong FROM preds WHERE split = 'calib' AND u IS NOT NULL),
  r AS (SELECT variant, u, row_number() OVER w AS i, avg(wrong) OVER (PARTITION BY variant ORDER BY u, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS err FROM p WINDOW w AS (PARTITION BY variant ORDER BY u, item_no))
  SELECT variant, coalesce(max_by(u, i) FILTER (WHERE err <= 0.3e0), min(u)) AS tau FROM r GROUP BY variant""",
)
plan(
    "u14_uncertainty_signals",
    """SELECT item_no, variant, round(u, 6) AS decision_entropy, coalesce(round(u, 6), CAST('Infinity' AS DOUBLE)) = CAST('Infinity' AS DOUBLE) AS missing, -abs(logit_margin) AS neg_margin, -logit_margin AS neg_logprob FROM preds""",
)
plan("u15_entropy_cross_check", f"SELECT variant, count(*) AS n, round({rate('abs(u - (ln(1e0 + exp(-abs(logit_margin))) + abs(logit_margin) * (1e0 - 1e0 / (1e0 + exp(-abs(logit_margin)))))) < 1e-6')}, 9) AS agree FROM preds WHERE u IS NOT NULL GROUP BY variant")
plan("u16_deferral", "SELECT variant, count_if(abstained) AS deferred, count_if(abstained <> coalesce(uq AND NOT gate_fired AND (pred IS NULL OR coalesce(u, 9e0) > 0.5e0), FALSE)) AS wrong FROM preds GROUP BY variant")
plan(
    "u17_calibration_pool",
    """WITH f AS (SELECT variant, count_if(NOT gate_fired AND u IS NOT NULL) AS finite, count_if(NOT gate_fired) AS open_n FROM preds WHERE split = 'calib' GROUP BY variant)
  SELECT p.variant, CASE WHEN f.finite > 0 THEN 'finite' WHEN f.open_n > 0 THEN 'open' ELSE 'all' END AS rule, count(*) AS n FROM preds p JOIN f ON f.variant = p.variant WHERE p.split = 'calib' AND CASE WHEN f.finite > 0 THEN NOT p.gate_fired AND p.u IS NOT NULL WHEN f.open_n > 0 THEN NOT p.gate_fired ELSE TRUE END GROUP BY 1, 2""",
)
plan(
    "u18_option_entropy",
    """WITH o AS (SELECT item_no, k.i AS opt, ((item_no * 31 + k.i * 17) % 41) / 10e0 AS z FROM items CROSS JOIN range(0, 4) AS k(i)), m AS (SELECT item_no, max(z) AS top FROM o GROUP BY item_no), s AS (SELECT o.item_no, sum(exp(z - top)) AS t FROM o JOIN m ON m.item_no = o.item_no GROUP BY o.item_no),
  p AS (SELECT o.item_no, exp(z - m.top) / s.t AS p FROM o JOIN m ON m.item_no = o.item_no JOIN s ON s.item_no = o.item_no) SELECT item_no, round(-sum(p * ln(p)), 6) AS option_entropy, round(max(p), 6) AS top_prob FROM p GROUP BY item_no""",
)
plan("u21_label_swap", "SELECT id, pair_id, CASE WHEN (sid * 2654435761 + rule_order * 97) % 1000003 % 2 = 0 THEN CASE WHEN label = 'SAFE' THEN 'UNSAFE' ELSE 'SAFE' END ELSE label END AS swapped FROM items WHERE NOT is_control")

plan("w01_nearest_pick", "SELECT family, sid, arm, event_id, factor_value, round(abs(q - threshold), 6) AS gap FROM items WHERE NOT is_control")
plan("w01_extreme_pick", "WITH r AS (SELECT family, sid, unsafe, event_id, q, row_number() OVER (PARTITION BY family, sid, unsafe ORDER BY abs(q - threshold) DESC, ts, event_id) AS rn FROM facts) SELECT family, sid, unsafe, event_id, q FROM r WHERE rn = 1")
plan("w02_control_pick", "SELECT family, sid, label, min(factor_value) AS low, max(factor_value) AS high, round(max(q) - min(q), 6) AS spread FROM items WHERE is_control GROUP BY family, sid, label")
plan("w04_tie_blocks", "SELECT variant, u, CAST(max(n) AS BIGINT) AS last_index FROM (SELECT variant, u, count(*) OVER (PARTITION BY variant ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM preds WHERE u IS NOT NULL) AS x GROUP BY variant, u")
plan("w05_average_rank", "SELECT variant, item_no, rank() OVER (PARTITION BY variant ORDER BY u) + (count(*) OVER (PARTITION BY variant, u) - 1) / 2e0 AS avg_rank FROM preds WHERE u IS NOT NULL")
plan("w07_running_max", "SELECT sid, event_id, max(value) OVER (PARTITION BY sid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM labs")
plan("w08_neighbours", "SELECT event_id, round(value - before, 2) AS from_last, round(after - value, 2) AS to_next FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY sid, item ORDER BY ts, event_id) AS before, lead(value) OVER (PARTITION BY sid, item ORDER BY ts, event_id) AS after FROM labs) AS x")
plan("w09_first_seen", "SELECT prompt, item_no, split FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY item_no) AS rn FROM items) AS x WHERE rn = 1")
plan("w10_top_fraction", "SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS BIGINT) AS place, round(percent_rank() OVER (PARTITION BY lang ORDER BY n_chars, doc_id), 9) AS share FROM documents")
plan("w11_previous_group", "SELECT family, sid, delta, lag(delta) OVER (PARTITION BY family ORDER BY sid) AS prev_delta FROM (SELECT family, sid, round(max(q) - min(q), 6) AS delta FROM items WHERE NOT is_control GROUP BY family, sid) AS x")
plan("w12_fill_forward", "SELECT sid, event_id, max(mark) OVER (PARTITION BY sid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_mark FROM (SELECT sid, event_id, ts, CASE WHEN item = 'signup' THEN ts END AS mark FROM labs) AS x")
plan("w13_ladder_steps", "SELECT variant, lead(variant) OVER (ORDER BY v) AS next_variant, round(lead(acc) OVER (ORDER BY v) - acc, 9) AS step FROM (SELECT v, variant, avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) AS acc FROM preds GROUP BY v, variant) AS x")

"""Relational plans in SQL (joins, filters, sampling, sets, execution, time); some check the functions of audits and sampling."""

from __future__ import annotations

from counterlens.plans.registry import plan, rate

# ---- sources and filters
plan("s03_patients", "SELECT sid, age, sex FROM patients")
plan("s04_filtered_scan", "SELECT sid, event_id, value FROM labs WHERE item = 'view' AND value BETWEEN 5 AND 200")
plan("s05_shared_scan", "SELECT family, count(*) AS n, round(min(q), 6) AS lo, round(max(q), 6) AS hi, count(DISTINCT sid) AS n_patients FROM facts GROUP BY family")
plan("s06_pushdown_projection", lambda d: f"SELECT user_id AS subject_id, event_type AS itemid, {d.stamp('ts')} AS charttime, value AS valuenum FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL")
plan("s07_key_lookup", "SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = 1)")
plan("s21_build_metadata", "SELECT split, count(*) AS n, count(DISTINCT sid) AS n_patients, count(DISTINCT pair_id) AS n_pairs FROM items GROUP BY split")
plan("p02_age_window", "SELECT count_if(age BETWEEN 18 AND 91) AS inside, count_if(age >= 65) AS old FROM patients")
plan("p04_label_rule", "SELECT event_id, family, CASE WHEN op = '<' THEN CASE WHEN q < threshold THEN 'UNSAFE' ELSE 'SAFE' END WHEN op = '>' THEN CASE WHEN q > threshold THEN 'UNSAFE' ELSE 'SAFE' END ELSE CASE WHEN q >= threshold THEN 'UNSAFE' ELSE 'SAFE' END END AS label FROM facts")
plan("p05_straddle", "SELECT pair_id, family, bool_or(q < threshold) AND bool_or(q >= threshold) AS crosses FROM items GROUP BY pair_id, family")
plan("p07_prompts", "SELECT id, prompt, CAST(length(prompt) AS BIGINT) AS n FROM items")
plan("p12_case_views", "SELECT variant, count_if(gate_fired) AS fired, count_if(NOT gate_fired) AS governed, count_if(NOT abstained) AS answered, count_if(pred IS NOT NULL) AS parsed FROM preds GROUP BY variant")
plan("p13_default_missing", "SELECT family, count_if(coalesce(CASE WHEN arm = 'safe' THEN NULL ELSE is_control END, FALSE)) AS controls FROM items GROUP BY family")
plan("p15_variant_flags", "SELECT i.id, v.variant, v.rag, v.gate, v.uq, v.cl FROM items i CROSS JOIN variants v WHERE i.split = 'calib'")
# ---- joins
plan("j01_fact_dimension", "SELECT l.event_id, coalesce(p.age, -1) AS age, p.sex, CASE WHEN p.sid IS NULL THEN 'no_demographics' END AS reason FROM labs l LEFT JOIN (SELECT * FROM patients WHERE sid % 7 <> 0) AS p ON p.sid = l.sid")
plan("j02_events_rules", "SELECT r.family, count(*) AS n FROM labs l JOIN rules r ON r.item = l.item GROUP BY r.family")
plan("j03_enrich", "SELECT p.variant, i.is_control, count(*) AS n FROM (SELECT variant, id FROM preds) AS p LEFT JOIN (SELECT id, is_control FROM items) AS i ON i.id = p.id GROUP BY p.variant, i.is_control")
plan("j04_pair_assembly", "SELECT variant, pair_id, max(CASE WHEN arm IN ('unsafe', 'ctrl_a') THEN pred END) AS pred_a, max(CASE WHEN arm IN ('safe', 'ctrl_b') THEN pred END) AS pred_b FROM preds GROUP BY variant, pair_id HAVING count(*) = 2")
plan("j05_aligned_variants", "SELECT a.id, a.correct AS base_ok, b.correct AS all_ok FROM preds a JOIN preds b ON a.id = b.id AND b.variant = 'nsai_uq_cl' WHERE a.variant = 'base'")
plan("j06_base_on_fired", f"SELECT g.variant, g.gate_fired, count(*) AS n, round({rate('b.correct')}, 9) AS base_accuracy, round({rate('g.correct')}, 9) AS accuracy FROM preds g JOIN preds b ON b.id = g.id AND b.variant = 'base' WHERE g.gate GROUP BY g.variant, g.gate_fired")
plan("j07_before_after", "SELECT b.family, count(*) AS n, count_if(NOT (a.pred IS NOT DISTINCT FROM b.pred)) AS changed, count_if(a.correct AND NOT b.correct) AS broke, count_if(b.correct AND NOT a.correct) AS fixed FROM preds a JOIN preds b ON a.id = b.id AND b.variant = 'rag' WHERE a.variant = 'base' GROUP BY b.family")
plan("j09_split_leakage", "WITH d AS (SELECT DISTINCT text, doc_id % 4 AS split FROM documents) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM d a JOIN d b ON a.text = b.text AND a.split < b.split GROUP BY a.split, b.split")
plan("j10_prompt_overlap", "SELECT i.split, count(DISTINCT i.prompt) AS shared FROM items i WHERE i.split <> 'train' AND EXISTS (SELECT 1 FROM items t WHERE t.split = 'train' AND t.prompt = i.prompt) GROUP BY i.split")
plan("j11_exclusion", "SELECT family, count(*) AS n FROM items i WHERE NOT i.held_out AND NOT EXISTS (SELECT 1 FROM items h WHERE h.held_out AND h.sid = i.sid) GROUP BY family")
plan("j12_unseen_pairs", "WITH s AS (SELECT i.pair_id, i.split, CASE WHEN t.prompt IS NULL THEN FALSE ELSE TRUE END AS seen FROM items i LEFT JOIN (SELECT DISTINCT prompt FROM items WHERE split = 'train') AS t ON t.prompt = i.prompt WHERE i.split = 'test') SELECT pair_id FROM s GROUP BY pair_id HAVING NOT bool_or(seen)")
# the time bucket makes the range join an equi join: each event meets its own and the neighbouring buckets
NEAREST = """pr AS (SELECT pair_id, sid, min(t) AS t0 FROM (SELECT pair_id, sid, {sec} AS t FROM items WHERE NOT is_control) AS x GROUP BY pair_id, sid), bk AS (SELECT p.*, floor(t0 / 604800e0) + o.i - 1 AS bucket FROM pr p CROSS JOIN range(0, 3) AS o(i)),
  nt AS (SELECT event_id AS note_id, sid, {sec} AS t, floor({sec} / 604800e0) AS bucket, value FROM labs WHERE item = 'signup'),
  c AS (SELECT b.pair_id, n.note_id, n.value, abs(floor((n.t - b.t0) / 86400e0)) AS gap FROM bk b JOIN nt n ON n.sid = b.sid AND n.bucket = b.bucket WHERE abs(floor((n.t - b.t0) / 86400e0)) <= 6)"""
plan("j13_nearest_note", lambda d: f"WITH {NEAREST.replace('{sec}', d.seconds('ts'))} SELECT pair_id, note_id, CAST(gap AS BIGINT) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY gap, note_id) AS rn FROM c) AS x WHERE rn = 1")
plan("j14_nearest_usable", lambda d: f"WITH {NEAREST.replace('{sec}', d.seconds('ts'))} SELECT pair_id, note_id, CAST(gap AS BIGINT) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY gap, note_id) AS rn FROM c WHERE value > 50) AS x WHERE rn = 1")
plan("j18_span_overlap", "WITH t AS (SELECT conv_id, turn, turn * 10 AS s, turn * 10 + 8 AS e FROM conversations), c AS (SELECT conv_id, 5 + conv_id % 20 AS a, 15 + conv_id % 20 AS b FROM conversations GROUP BY conv_id) SELECT t.conv_id, t.turn FROM t JOIN c ON c.conv_id = t.conv_id WHERE t.e > c.a AND t.s < c.b AND t.e > t.s")
plan("j23_control_follows", "SELECT c.pair_id, p.pair_id AS causal FROM (SELECT DISTINCT pair_id, substr(pair_id, 1, length(pair_id) - 6) AS base FROM items WHERE is_control) AS c JOIN (SELECT DISTINCT pair_id FROM items WHERE NOT is_control) AS p ON p.pair_id = c.base")
# ---- order, sampling, splitting
plan("o01_top_k_retrieval", lambda d: f"WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, c.vec_id, round({d.dot('q.embedding', 'c.embedding')}, 6) AS sim FROM q CROSS JOIN embeddings c) SELECT query_id, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id DESC) AS rn FROM s) AS x WHERE rn <= 3")
plan("o02_top_features", "SELECT source, n FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rn FROM documents GROUP BY source) AS x WHERE rn <= 5")
plan("o03_display_order", "SELECT p.variant, count(*) AS n, min(v.v) AS place FROM preds p JOIN variants v ON v.variant = p.variant GROUP BY p.variant ORDER BY place")
plan("o06_pair_sample", "SELECT split, pair_id FROM (SELECT split, pair_id, row_number() OVER (PARTITION BY split ORDER BY (min(item_no) * 2654435761) % 1000003, pair_id) AS rn FROM items WHERE NOT is_control GROUP BY split, pair_id) AS x WHERE rn <= 10")
plan("o07_stratified", "WITH s AS (SELECT variant, CASE WHEN abstained THEN 'deferral' WHEN label = 'UNSAFE' AND pred = 'SAFE' THEN 'violation' ELSE 'other' END AS stratum, id, h1 FROM preds) SELECT variant, stratum, id FROM (SELECT *, row_number() OVER (PARTITION BY variant, stratum ORDER BY h1, id) AS rn FROM s) AS x WHERE rn <= CASE stratum WHEN 'other' THEN 4 ELSE 3 END")
plan("o09_blinded_key", lambda d: f"SELECT id, 'IT' || upper(substr({d.sha("id || '||' || family")}, 1, 10)) AS blinded FROM items")
plan("o10_refill", "SELECT family, pair_id FROM (SELECT family, pair_id, row_number() OVER (PARTITION BY family ORDER BY (min(item_no) * 31) % 1009, pair_id) AS rn FROM items WHERE factor_value > 20 GROUP BY family, pair_id HAVING count(*) = 2) AS x WHERE rn <= 12")
plan("o11_background_sample", "SELECT doc_id, item_no FROM (SELECT sid AS doc_id, event_id AS item_no, row_number() OVER (PARTITION BY sid ORDER BY (event_id * 2654435761) % 1000003, event_id) AS rn FROM labs WHERE item <> 'view') AS x WHERE rn <= 8")
plan("o12_budget", "SELECT doc_id, running FROM (SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM documents) AS x WHERE running <= 50000")
# ---- sets
plan("t01_union", "SELECT family, n FROM (SELECT family, count(*) AS n FROM items GROUP BY family UNION ALL SELECT 'POOLED', count(*) FROM items) AS x")
plan("t02_intersect", "SELECT prompt FROM items WHERE split = 'test' INTERSECT SELECT prompt FROM items WHERE split = 'train'")
plan("t03_except", "SELECT sid FROM items WHERE family = 'egfr45' EXCEPT SELECT sid FROM items WHERE family = 'egfr30'")
plan("t04_equal_sets", "SELECT (SELECT count(*) FROM (SELECT id FROM items EXCEPT SELECT id FROM preds) AS a) = 0 AND (SELECT count(*) FROM (SELECT id FROM preds EXCEPT SELECT id FROM items) AS b) = 0 AS equal")
plan("t05_upsert", "WITH old AS (SELECT variant, 0 AS seed, count(*) AS n FROM preds WHERE v < 5 GROUP BY variant), new AS (SELECT variant, 0 AS seed, count_if(correct) AS n FROM preds WHERE v >= 3 GROUP BY variant) SELECT variant, seed, n FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.variant = old.variant AND new.seed = old.seed) UNION ALL SELECT variant, seed, n FROM new")
# ---- execution
plan("x04_stub_backends", f"WITH s AS (SELECT b.backend, i.pair_id, i.label, CASE b.backend WHEN 'oracle' THEN i.label WHEN 'inverted' THEN CASE WHEN i.label = 'SAFE' THEN 'UNSAFE' ELSE 'SAFE' END WHEN 'coin' THEN CASE WHEN i.item_no * 2654435761 % 1000003 % 2 = 0 THEN 'SAFE' ELSE 'UNSAFE' END ELSE CASE WHEN i.item_no * 2654435761 % 1000003 % 10 < 6 THEN i.label ELSE 'SAFE' END END AS pred FROM items i CROSS JOIN (VALUES ('oracle'), ('inverted'), ('coin'), ('sixty')) AS b(backend)) SELECT backend, round({rate('pred = label')}, 9) AS accuracy FROM s GROUP BY backend")
# ---- time
plan("d01_parse_time", lambda d: f"SELECT event_id, {d.parse_stamp(d.stamp('ts'))} AS parsed FROM events")
plan("d02_day_gap", lambda d: f"SELECT sid, event_id, CAST(abs(floor(({d.seconds('ts')} - min({d.seconds('ts')}) OVER (PARTITION BY sid)) / 86400e0)) AS BIGINT) AS gap FROM labs")
plan("d03_format_time", lambda d: f"SELECT event_id, {d.stamp('ts')} AS charttime FROM events")

"""The same items and predictions in SQL of the oracle engine, for comparison only."""

BASE = """
patients AS (SELECT DISTINCT user_id AS sid, 18 + (user_id * 7) % 73 AS age, CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END AS sex FROM events),
rules AS (SELECT * FROM (VALUES ('egfr30', 0::BIGINT, 'view', 'ckd_epi', '<', 30e0, FALSE, 'attested'), ('egfr45', 1, 'view', 'ckd_epi', '<', 45e0, FALSE, 'attested'),
  ('high', 2, 'click', 'identity', '>', 150e0, FALSE, 'assumed'), ('held', 3, 'purchase', 'identity', '>', 120e0, TRUE, 'unattested')) AS t(family, rule_order, item, convert, op, threshold, held_out, provenance)),
variants AS (SELECT * FROM (VALUES (0::BIGINT, 'base', FALSE, FALSE, FALSE, FALSE), (1, 'rag', TRUE, FALSE, FALSE, FALSE), (2, 'sym', FALSE, TRUE, FALSE, FALSE), (3, 'uq', FALSE, FALSE, TRUE, FALSE),
  (4, 'cl', FALSE, FALSE, FALSE, TRUE), (5, 'nsai', TRUE, TRUE, FALSE, FALSE), (6, 'nsai_uq', TRUE, TRUE, TRUE, FALSE), (7, 'nsai_uq_cl', TRUE, TRUE, TRUE, TRUE)) AS t(v, variant, rag, gate, uq, cl)),
labs AS (SELECT event_id, user_id AS sid, event_type AS item, ts, round(value, 2) AS value FROM events WHERE value IS NOT NULL),
facts0 AS (SELECT l.*, r.family, r.rule_order, r.convert, r.op, r.threshold, r.held_out, p.age, p.sex, 0.3e0 + l.value / 40e0 AS scr FROM labs l JOIN rules r USING (item) JOIN patients p USING (sid)),
facts AS (SELECT *, CASE WHEN op = '<' THEN q < threshold ELSE q > threshold END AS unsafe FROM (SELECT *, round(CASE WHEN convert = 'ckd_epi' THEN
  142e0 * pow(scr / CASE WHEN sex = 'female' THEN 0.7e0 ELSE 0.9e0 END, CASE WHEN sex = 'female' AND scr <= 0.7e0 THEN -0.241e0 WHEN sex = 'male' AND scr <= 0.9e0 THEN -0.302e0 ELSE -1.2e0 END)
  * pow(0.9938e0, age) * CASE WHEN sex = 'female' THEN 1.012e0 ELSE 1e0 END ELSE value END, 6) AS q FROM facts0 WHERE age BETWEEN 18 AND 91)),
near AS (SELECT *, row_number() OVER (PARTITION BY family, sid, unsafe ORDER BY abs(q - threshold), ts, event_id) AS rn FROM facts),
causal AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY family, sid) AS sides FROM near WHERE rn = 1) WHERE sides = 2),
free AS (SELECT f.*, row_number() OVER (PARTITION BY f.family, f.sid, f.unsafe ORDER BY q, f.ts, f.event_id) AS ra, row_number() OVER (PARTITION BY f.family, f.sid, f.unsafe ORDER BY q DESC, f.ts, f.event_id) AS rb
  FROM facts f WHERE NOT EXISTS (SELECT 1 FROM causal c WHERE c.family = f.family AND c.sid = f.sid AND c.ts = f.ts)),
spreads AS (SELECT a.family, a.sid, a.unsafe, b.q - a.q AS spread FROM free a JOIN free b ON a.family = b.family AND a.sid = b.sid AND a.unsafe = b.unsafe WHERE a.ra = 1 AND b.rb = 1 AND b.q > a.q),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, sid ORDER BY spread DESC, unsafe) AS rn FROM spreads) WHERE rn = 1),
arms AS (SELECT family, sid, unsafe, event_id, ts, value, q, CASE WHEN unsafe THEN 'unsafe' ELSE 'safe' END AS arm, FALSE AS is_control FROM causal
  UNION ALL SELECT f.family, f.sid, f.unsafe, f.event_id, f.ts, f.value, f.q, 'ctrl_a', TRUE FROM free f JOIN chosen c ON f.family = c.family AND f.sid = c.sid AND f.unsafe = c.unsafe WHERE ra = 1
  UNION ALL SELECT f.family, f.sid, f.unsafe, f.event_id, f.ts, f.value, f.q, 'ctrl_b', TRUE FROM free f JOIN chosen c ON f.family = c.family AND f.sid = c.sid AND f.unsafe = c.unsafe WHERE rb = 1),
numbered AS (SELECT a.*, r.rule_order, r.op, r.threshold, r.held_out, a.sid * 32 + r.rule_order * 8 + 2 * CASE arm WHEN 'unsafe' THEN 0 WHEN 'safe' THEN 1 WHEN 'ctrl_a' THEN 2 ELSE 3 END AS item_no,
  a.family || '_' || CAST(a.sid AS VARCHAR) || CASE WHEN is_control THEN '__ctrl' ELSE '' END AS pair_id FROM arms a JOIN rules r USING (family) WHERE EXISTS (SELECT 1 FROM causal c WHERE c.family = a.family AND c.sid = a.sid)),
items AS (SELECT item_no, pair_id || '_' || arm AS id, pair_id, family, rule_order, held_out, arm, CASE WHEN unsafe THEN 'UNSAFE' ELSE 'SAFE' END AS label, is_control, sid, event_id, ts, value AS factor_value, q, op, threshold,
  CASE WHEN held_out THEN 'heldout' WHEN (sid * 2654435761) % 1000003 % 10 < 5 THEN 'test' WHEN (sid * 2654435761) % 1000003 % 10 < 7 THEN 'calib' ELSE 'train' END AS split,
  'Patient on ' || family || ' has value ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) || '. Is it safe?' AS prompt, CASE WHEN item_no % 3 = 0 THEN 'implicit' ELSE 'explicit' END AS presentation FROM numbered),
hashed AS (SELECT i.*, v.*, (item_no * 2654435761 + v * 40503) % 1000003 AS h1, (item_no * 97531 + v * 7919 + 12345) % 1000003 AS h2 FROM items i CROSS JOIN variants v),
owned AS (SELECT *, gate AND h2 % 10 < 6 AS gate_fired, CASE WHEN h2 % 50 = 0 THEN NULL WHEN h1 < 600000 + v * 40000 THEN label WHEN label = 'SAFE' THEN 'UNSAFE' ELSE 'SAFE' END AS own,
  CASE WHEN h1 % 17 = 0 THEN NULL ELSE (h2 % 81 - 40) / 10e0 END AS logit_margin FROM hashed),
sured AS (SELECT *, CASE WHEN gate_fired THEN label ELSE own END AS pred, 1e0 / (1e0 + exp(-abs(logit_margin))) AS p FROM owned),
scored AS (SELECT *, round(CASE WHEN p >= 1 THEN 0e0 ELSE -(p * ln(p) + (1e0 - p) * ln(1e0 - p)) END, 9) AS u FROM sured),
deferred AS (SELECT *, coalesce(uq AND NOT gate_fired AND (pred IS NULL OR u IS NULL OR u > 0.5e0), FALSE) AS abstained FROM scored),
preds AS (SELECT *, CASE WHEN own IS NULL THEN 'I cannot tell from this.' WHEN own = 'SAFE' THEN 'Answer: safe, the value is within range.' WHEN h1 % 2 = 0 THEN 'It is NOT SAFE here.' ELSE 'Unsafe: the threshold is crossed.' END AS raw,
  coalesce(NOT abstained AND pred = label, FALSE) AS correct FROM deferred)
"""

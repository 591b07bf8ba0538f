"""Text and formula plans in SQL."""

from __future__ import annotations

from counterlens.plans.registry import plan

NUMBER = "([0-9]+(?:[.][0-9]+)?)"


def num(d, column: str, pattern: str) -> str:
    return f"CAST(nullif({d.extract(column, pattern, 1)}, '') AS DOUBLE)"


plan("f10_decimals", lambda d: f"SELECT event_id, CAST(length({d.extract('CAST(CAST(value AS DECIMAL(18, 2)) AS STRING)', '[.]([0-9]*[1-9])0*$', 1)}) AS BIGINT) AS decimals FROM labs")
plan("f23_normalise", lambda d: f"SELECT DISTINCT upper(trim(event_type)) AS label, replace(replace(event_type, '&', '&amp;'), '<', '&lt;') AS escaped, {d.replace_all('lower(event_type)', '[^a-z0-9]+', '-')} AS slug FROM events")
plan(
    "f24_rating_parse",
    """SELECT doc_id, CASE WHEN s IN ('yes', 'y', 'true', '1') THEN 1e0 WHEN s IN ('no', 'n', 'false', '0') THEN 0e0 END AS yes, CASE s WHEN '1' THEN 1e0 WHEN '2' THEN 2e0 WHEN '3' THEN 3e0 WHEN '4' THEN 4e0 WHEN '5' THEN 5e0 END AS grade
  FROM (SELECT doc_id, lower(trim(CASE doc_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'n' WHEN 2 THEN '4' WHEN 3 THEN '9' WHEN 4 THEN CAST(quality AS STRING) ELSE '' END)) AS s FROM labels) AS x""",
)
# ---- formulas
VITALS = "vitals AS (SELECT l.event_id, p.age, p.sex, 0.3e0 + l.value / 40e0 AS scr, 45e0 + l.event_id % 60 AS weight, 150e0 + l.event_id % 45 AS height, 300e0 + l.event_id % 250 AS qt, 40e0 + l.event_id % 100 AS hr FROM labs l JOIN patients p ON p.sid = l.sid)"
plan("m02_mdrd", f"WITH {VITALS} SELECT event_id, round(175e0 * pow(scr, -1.154e0) * pow(CAST(age AS DOUBLE), -0.203e0) * CASE WHEN sex = 'female' THEN 0.742e0 ELSE 1e0 END, 6) AS gfr FROM vitals")
plan("m03_cockcroft_gault", f"WITH {VITALS}, b AS (SELECT *, weight / pow(height / 100e0, 2e0) AS bmi, CASE WHEN sex = 'male' THEN 50e0 ELSE 45.5e0 END + 2.3e0 * (height / 2.54e0 - 60e0) AS ibw FROM vitals) SELECT event_id, round((140e0 - age) * CASE WHEN bmi < 18.5e0 THEN weight WHEN bmi < 25e0 THEN least(ibw, weight) ELSE ibw + 0.4e0 * (weight - ibw) END * CASE WHEN sex = 'male' THEN 1e0 ELSE 0.85e0 END / (scr * 72e0), 6) AS crcl FROM b")
plan("m04_units", "SELECT event_id, unit, round(CASE WHEN instr(unit, 'umol') > 0 THEN value / 88.4e0 WHEN instr(unit, 'mg/dl') > 0 THEN value END, 6) AS mgdl FROM (SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN 'umol/l' WHEN 1 THEN 'mg/dl' ELSE 'g/l' END AS unit FROM labs) AS x")
plan("m06_qtc", f"WITH {VITALS} SELECT event_id, round(qt / sqrt(60e0 / hr), 6) AS bazett, round(qt / pow(60e0 / hr, 1e0 / 3e0), 6) AS fridericia, round(qt + 154e0 * (1e0 - 60e0 / hr), 6) AS framingham, round(qt + 1.75e0 * (hr - 60e0), 6) AS hodges, round(qt * (120e0 + hr) / 180e0, 6) AS rautaharju FROM vitals")
plan("m09_target_draw", "SELECT id, round(threshold + CASE WHEN label = 'UNSAFE' AND op = '<' OR label = 'SAFE' AND op = '>' THEN -1e0 ELSE 1e0 END * threshold * (0.1e0 + 0.4e0 * ((item_no * 2654435761) % 1000003) / 1000003e0), 6) AS target FROM items")
plan("m11_cosine", lambda d: f"SELECT a.vec_id, b.vec_id AS other, round({d.dot('a.embedding', 'b.embedding')} / (sqrt({d.dot('a.embedding', 'a.embedding')}) * sqrt({d.dot('b.embedding', 'b.embedding')})), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
plan("m12_rescale", lambda d: f"SELECT label, round(sqrt(64e0) / avg(sqrt({d.dot('embedding', 'embedding')})), 6) AS scale FROM embeddings GROUP BY label")

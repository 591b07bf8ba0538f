"""SQL of the checking engine for text, gates, retrieval, graph, features and audits.

Notes and cases are checked against what they were made from, not against a second
extraction. Patterns with look-around, which the engine lacks, are written otherwise.
"""

from __future__ import annotations

from counterlens.operators import concepts, retrieval
from counterlens.plans import samples
from counterlens.plans.oracle import with_base

TRUTH = """n0 AS (SELECT l.*, p.age, p.sex, event_id % 6 AS kind, (30 + CAST(floor(value * 100 / 40) AS BIGINT)) / 100e0 AS cr, (30 + event_id % 400) / 88.4e0 AS um, 300 + event_id % 250 AS qt, 40 + event_id % 100 AS hr, 45e0 + event_id % 60 AS kg, 150e0 + event_id % 45 AS cm,
  (5 + event_id % 40) / 10e0 AS bil, (20 + event_id % 25) / 10e0 AS alb, (10 + event_id % 20) / 10e0 AS inr, 1 + event_id % 3 AS a, 1 + (event_id // 3) % 3 AS e FROM labs l JOIN patients p ON p.sid = l.sid),
  n AS (SELECT *, CASE kind WHEN 0 THEN cr WHEN 1 THEN um WHEN 3 THEN cr END AS scr, CASE WHEN kind < 5 THEN age END AS t_age, CASE WHEN kind < 5 THEN sex ELSE 'female' END AS t_sex FROM n0)"""
EPI = "142e0 * pow(scr / CASE WHEN sex = 'female' THEN 0.7e0 ELSE 0.9e0 END, CASE WHEN sex = 'female' AND scr <= 0.7e0 THEN -0.241e0 WHEN sex = 'male' AND scr <= 0.9e0 THEN -0.302e0 ELSE -1.2e0 END) * pow(0.9938e0, age) * CASE WHEN sex = 'female' THEN 1.012e0 ELSE 1e0 END"
MDRD = "175e0 * pow(scr, -1.154e0) * pow(CAST(age AS DOUBLE), -0.203e0) * CASE WHEN sex = 'female' THEN 0.742e0 ELSE 1e0 END"
IBW = "(CASE WHEN sex = 'male' THEN 50e0 ELSE 45.5e0 END + 2.3e0 * (cm / 2.54e0 - 60e0))"
CG = f"(140e0 - age) * CASE WHEN kg / pow(cm / 100e0, 2e0) < 18.5e0 THEN kg WHEN kg / pow(cm / 100e0, 2e0) < 25e0 THEN least({IBW}, kg) ELSE {IBW} + 0.4e0 * (kg - {IBW}) END * CASE WHEN sex = 'male' THEN 1e0 ELSE 0.85e0 END / (scr * 72e0)"
B3, A3, I3 = "CASE WHEN {0} < 2 THEN 1 WHEN {0} <= 3 THEN 2 ELSE 3 END", "CASE WHEN {0} > 3.5e0 THEN 1 WHEN {0} >= 2.8e0 THEN 2 ELSE 3 END", "CASE WHEN {0} < 1.7e0 THEN 1 WHEN {0} <= 2.3e0 THEN 2 ELSE 3 END"


def gated(equation: str) -> str:
    return f"""{TRUTH}, g0 AS (SELECT *, CASE kind WHEN 0 THEN 'metformin' WHEN 1 THEN 'metformin' WHEN 2 THEN 'ondansetron' WHEN 3 THEN 'nitrofurantoin' WHEN 4 THEN 'apixaban' ELSE 'metformin' END AS drug,
  CASE WHEN kind IN (0, 1) THEN {equation} WHEN kind = 2 THEN qt / sqrt(60e0 / hr) WHEN kind = 3 THEN {CG} WHEN kind = 4 THEN CAST({B3.format('bil')} + {A3.format('alb')} + {I3.format('inr')} + a + e AS DOUBLE) END AS q FROM n),
  g AS (SELECT *, CASE WHEN kind = 5 THEN 'creatinine_mgdl+age' WHEN kind IN (0, 1) AND NOT (scr BETWEEN 0.15e0 AND 25e0 AND q BETWEEN 2e0 AND 200e0) THEN 'implausible' WHEN kind = 2 AND NOT (qt BETWEEN 200 AND 700 AND hr BETWEEN 25 AND 220 AND q BETWEEN 250 AND 750) THEN 'implausible' WHEN kind = 3 AND NOT scr BETWEEN 0.15e0 AND 25e0 THEN 'implausible' END AS declined,
  CASE kind WHEN 2 THEN q > 500 WHEN 3 THEN q < 60 WHEN 4 THEN q >= 10 ELSE q < 30 END AS beyond FROM g0)"""


CLAIMS = """cur AS (SELECT p_brand AS drug, 'F:' || p_type AS finding, p_name AS family, [lower(p_type), 'k' || CAST(p_partkey // 11 AS VARCHAR)] AS atoms FROM part WHERE p_partkey % 3 = 0),
  ont AS (SELECT p_brand AS drug, CASE WHEN p_partkey % 35 = 1 THEN 'F:' || p_type ELSE 'T:' || p_name END AS target, ['CONTRAINDICATED_WITH', 'HAS_MECHANISM', 'HAS_PHYSIOLOGIC_EFFECT', 'MAY_TREAT'][p_partkey // 3 % 4 + 1] AS rel, ['k' || CAST(p_partkey // 11 AS VARCHAR)] AS atoms FROM part WHERE p_partkey % 3 <> 0 AND p_brand IN (SELECT drug FROM cur)),
  edges AS (SELECT drug AS src, finding AS dst, 'CONTRAINDICATED_WITH' AS rel, 'curated' AS provenance, min(family) AS source FROM cur GROUP BY 1, 2 UNION ALL SELECT DISTINCT drug, target, rel, 'umls', 'MED-RT' FROM ont),
  seen AS (SELECT drug AS cui, 'drug' AS kind, CAST([] AS VARCHAR[]) AS atoms, 0 AS seen FROM cur UNION ALL SELECT finding, 'disease', atoms, 1 FROM cur UNION ALL SELECT target, CASE WHEN rel IN ('CONTRAINDICATED_WITH', 'MAY_TREAT', 'MAY_PREVENT') THEN 'disease' ELSE 'process' END, CASE WHEN rel = 'CONTRAINDICATED_WITH' THEN atoms ELSE [] END, 2 FROM ont),
  kinds AS (SELECT cui, min(kind) AS kind FROM (SELECT *, min(seen) OVER (PARTITION BY cui) AS first FROM seen) WHERE seen = first GROUP BY cui),
  keyed AS (SELECT cui, min(list_sort(atoms)) AS atom_keys FROM (SELECT *, min(seen) OVER (PARTITION BY cui) AS first FROM seen WHERE len(atoms) > 0) WHERE seen = first GROUP BY cui),
  nodes AS (SELECT k.cui, k.kind, coalesce(a.atom_keys, []) AS atom_keys FROM kinds k LEFT JOIN keyed a ON a.cui = k.cui)"""
CLAIMS_BY_SIZE = CLAIMS.replace("p_partkey // 11", "p_size % 7")
ATTESTED = f"""{CLAIMS_BY_SIZE}, contra AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'CONTRAINDICATED_WITH' AND provenance = 'umls'), att AS (SELECT c.src, c.dst, c.source, (SELECT count(*) FROM contra u WHERE u.src = c.src) AS n_ontology, EXISTS (SELECT 1 FROM contra u WHERE u.src = c.src AND u.dst = c.dst) AS exact,
  (SELECT min(u.dst) FROM contra u JOIN nodes x ON x.cui = u.dst JOIN nodes y ON y.cui = c.dst WHERE u.src = c.src AND list_has_any(x.atom_keys, y.atom_keys)) AS synonym FROM edges c WHERE c.rel = 'CONTRAINDICATED_WITH' AND c.provenance = 'curated'),
  states AS (SELECT src, dst, source, CASE WHEN exact THEN 'exact' WHEN synonym IS NOT NULL THEN 'synonymous' ELSE 'curated' END AS state, CASE WHEN exact THEN dst ELSE synonym END AS matched, n_ontology FROM att)"""

_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP)


def terms(table: str, key: str, name: str) -> str:
    """Rows (k, term, tf) of a table of texts."""
    return f"""{name}_w AS (SELECT {key} AS k, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{retrieval.TOKEN}'), lambda w: w NOT IN ({_STOP})) AS w FROM {table}),
  {name} AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_w) GROUP BY k, term)"""


def cosine(corpus: str, key: str, queries: str, qkey: str) -> str:
    """Rows (qk, ck, score) of every query and passage, 0 without a common term."""
    return f"""{terms(corpus, key, 'ct')}, {terms(queries, qkey, 'qt')}, idf AS (SELECT term, ln((1e0 + (SELECT count(*) FROM {corpus})) / (1e0 + count(*))) + 1e0 AS idf FROM ct GROUP BY term),
  cv0 AS (SELECT k, ct.term, (1e0 + ln(tf)) * idf AS w FROM ct JOIN idf USING (term)), cv AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM cv0), qv0 AS (SELECT k, qt.term, (1e0 + ln(tf)) * idf AS w FROM qt JOIN idf USING (term)), qv AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM qv0),
  dots AS (SELECT q.k AS qk, c.k AS ck, sum(q.w * c.w) AS s FROM qv q JOIN cv c USING (term) GROUP BY 1, 2), sims AS (SELECT q.{qkey} AS qk, c.{key} AS ck, round(coalesce(s, 0e0), 12) AS score FROM {queries} q CROSS JOIN {corpus} c LEFT JOIN dots ON qk = q.{qkey} AND ck = c.{key}),
  top AS (SELECT qk, ck, score, row_number() OVER (PARTITION BY qk ORDER BY score DESC, ck DESC) AS rank FROM sims QUALIFY rank <= 3)"""


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else "TRUE" if v is True else "FALSE" if v is False else str(v) if isinstance(v, (int, float)) else "[" + ", ".join(map(show, v)) + "]::VARCHAR[]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


LABELS = "lab AS (SELECT source AS drug, lang AS section, doc_id AS seq, text FROM documents WHERE text IS NOT NULL)"
FOUND = f"""{LABELS}, spec AS (SELECT * FROM (VALUES {_values(samples.SPECS)}) AS t("order", family, drug, pattern, sections, kind, rules_value, known_trap)),
  hit AS (SELECT s.family, l.section, l.seq, l.text, s.pattern, CASE WHEN len(s.sections) = 0 THEN 1 ELSE list_position(s.sections, l.section) END AS place FROM spec s JOIN lab l ON l.drug = s.drug AND regexp_matches(l.text, s.pattern)),
  one AS (SELECT * FROM hit WHERE place > 0 QUALIFY row_number() OVER (PARTITION BY family ORDER BY place, section, seq) = 1),
  cut AS (SELECT family, section, regexp_extract(text, pattern, 1) AS value, length(regexp_extract(text, '(?s)^(.*?)' || pattern, 1)) AS before, length(regexp_extract(text, pattern, 0)) AS long, text FROM one),
  ctx AS (SELECT family, section, value, trim(regexp_replace(substr(text, greatest(1, before + 1 - 120), before + 1 + long + 120 - greatest(1, before + 1 - 120)), '[\\s\\x0b]+', ' ', 'g')) AS context FROM cut),
  found AS (SELECT s.*, c.section, c.value, c.context, CASE WHEN s.drug NOT IN (SELECT drug FROM lab) THEN 'no_label' WHEN c.section IS NULL THEN CASE WHEN known_trap THEN 'construct_mismatch' ELSE 'absent' END WHEN kind = 'qualitative' THEN 'attested_qualitative' WHEN try_cast(c.value AS DOUBLE) = rules_value THEN 'attested_exact' ELSE 'attested_different_value' END AS status FROM spec s LEFT JOIN ctx c ON c.family = s.family)"""
SENTENCES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.;])[\\s\\x0b]+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^[\\s\\x0b\\x85\\xA0\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x0b\\x85\\xA0\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g')), lambda s: s <> '')"
# \b of the engine knows ASCII only: other characters than of words are doubled, so that each match has bounds of its own
_WORDS = {c: (concepts.wordings(s, v, stop=["of"], name=c), concepts.wordings(s, (), stop=["of"], name=c)) for c, (s, v) in samples.CONCEPTS.items()}
_DOUBLED = r"regexp_replace(' ' || coalesce(text, '') || ' ', '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')".replace("{{", "{").replace("}}", "}")


def _matched(words: list[str]) -> str:
    body = "|".join(w.replace(" ", "  ") for w in sorted(words, key=len, reverse=True))
    return rf"[^\p{{L}}\p{{N}}_]((?i:{body}))[^\p{{L}}\p{{N}}_]"


def _count(words: list[str]) -> str:
    return f"len(regexp_extract_all({_DOUBLED}, '{_matched(words)}', 1))"


HITS = " UNION ALL ".join(f"SELECT lang, '{c}' AS concept, {_count(f)} AS f, {_count(b)} AS b FROM documents" for c, (f, b) in _WORDS.items())
WORD_AT = "CASE WHEN regexp_matches(lower(text), '\\b{0}\\b') THEN length(regexp_extract(lower(text), '(?s)^(.*?)\\b{0}\\b', 1)) END"
EFFECTS = """eff AS (SELECT i.pair_id, l.i AS layer, a.alpha, (i.h % 200 - 100) / 50e0 * a.alpha + l.i / 10e0 AS delta, (i.h % 90 - 45) / 60e0 AS control FROM (SELECT pair_id, min(item_no) * 2654435761 % 1000003 AS h FROM items WHERE NOT is_control GROUP BY pair_id) AS i CROSS JOIN range(0, 6) AS l(i) CROSS JOIN (VALUES (-1e0), (-0.5e0), (0.5e0), (1e0)) AS a(alpha)),
  cell AS (SELECT layer, alpha, round(avg(delta), 9) AS m FROM eff GROUP BY 1, 2), step AS (SELECT *, m - lag(m) OVER (PARTITION BY layer ORDER BY alpha) AS d FROM cell)"""
ACT = """act AS (SELECT e.event_id, f.i AS feature, e.event_type AS concept, 0.1e0 + (e.event_id * (f.i + 3) * 31 % 101) / 50e0 AS x FROM events e CROSS JOIN range(0, 12) AS f(i) WHERE (e.event_id * (f.i + 7) * 2654435761) % 1000003 % (4 + f.i) = 0),
  f1 AS (SELECT feature, concept, 2e0 * count(*) / ((SELECT count(*) FROM act b WHERE b.feature = a.feature) + (SELECT count(*) FROM events v WHERE v.event_type = a.concept)) AS f1 FROM act a GROUP BY feature, concept), best AS (SELECT feature, concept AS stands FROM f1 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(f1, 12) DESC, concept) = 1)"""
PROMPTS = "prompts AS (SELECT min(item_no) AS no, prompt AS text FROM preds WHERE variant = 'rag' GROUP BY prompt), corpus AS (SELECT 'guideline::' || family AS id, 'Threshold for ' || family || ' patients' AS text FROM rules UNION ALL SELECT 'distractor::' || CAST(item_id AS VARCHAR), text FROM benchmark)"
SHARE = "avg(CASE WHEN {0} THEN 1e0 ELSE 0e0 END)"
HITS_BY = ", ".join([f"round({SHARE.format(f'coalesce(place <= {k}, FALSE)')}, 9) AS hit{k}" for k in (1, 2, 3)])

SQL = {
    "m05_inverse": f"""WITH v AS (SELECT l.event_id, p.age, p.sex, 45e0 + l.event_id % 60 AS kg, CASE WHEN l.event_id % 7 > 0 THEN 150e0 + l.event_id % 45 END AS cm, l.event_id % 3 AS kind, CASE WHEN l.event_id % 11 = 0 THEN 2500e0 ELSE 45e0 END AS target FROM labs l JOIN patients p ON p.sid = l.sid),
  w AS (SELECT *, CASE WHEN cm IS NULL OR kg / pow(cm / 100e0, 2e0) < 18.5e0 THEN kg WHEN kg / pow(cm / 100e0, 2e0) < 25e0 THEN least({IBW}, kg) ELSE {IBW} + 0.4e0 * (kg - {IBW}) END AS dose, CASE WHEN sex = 'female' THEN 1.012e0 ELSE 1e0 END AS f, CASE WHEN sex = 'female' THEN 0.7e0 ELSE 0.9e0 END AS knee, CASE WHEN sex = 'female' THEN -0.241e0 ELSE -0.302e0 END AS lo FROM v),
  s AS (SELECT event_id, CASE kind WHEN 0 THEN (140e0 - age) * dose * CASE WHEN sex = 'male' THEN 1e0 ELSE 0.85e0 END / (72e0 * target) WHEN 1 THEN pow(target / (175e0 * pow(CAST(age AS DOUBLE), -0.203e0) * CASE WHEN sex = 'female' THEN 0.742e0 ELSE 1e0 END), 1e0 / -1.154e0) ELSE knee * pow(target / (142e0 * pow(0.9938e0, age) * f), 1e0 / CASE WHEN target >= 142e0 * pow(0.9938e0, age) * f THEN lo ELSE -1.2e0 END) END AS c FROM w)
  SELECT event_id, CASE WHEN c BETWEEN 0.05e0 AND 60e0 THEN round(c, 6) END AS creatinine FROM s""",
    "p01_implausible": f"""WITH v AS (SELECT l.event_id, p.age, p.sex, l.value / 20 AS scr, 150e0 + l.event_id % 600 AS qt, 15e0 + l.event_id % 230 AS hr, (10 + l.event_id % 90) / 10e0 AS k, (2 + l.event_id % 140) / 10e0 AS r FROM labs l JOIN patients p ON p.sid = l.sid), w AS (SELECT *, {EPI} AS g, qt / sqrt(60e0 / hr) AS c FROM v)
  SELECT event_id, CASE WHEN scr < 0.15e0 OR scr > 25 THEN 'creatinine_mgdl' WHEN g < 2 OR g > 200 THEN 'eGFR' WHEN qt < 200 OR qt > 700 THEN 'qt_ms' WHEN hr < 25 OR hr > 220 THEN 'heart_rate' WHEN c < 250 OR c > 750 THEN 'QTc' WHEN k < 1.5e0 OR k > 9 THEN 'potassium_mEqL' WHEN r < 0.5e0 OR r > 12 THEN 'inr' END AS bad FROM w""",
    "p06_drop_reasons": f"""WITH {TRUTH}, k AS (SELECT *, {EPI} AS g, row_number() OVER (PARTITION BY kind, CASE WHEN kind < 5 THEN age END, CASE WHEN kind < 5 THEN sex END, CASE WHEN kind IN (0, 3) THEN cr WHEN kind = 1 THEN um END, CASE WHEN kind = 2 THEN qt END, CASE WHEN kind = 2 THEN hr END, CASE WHEN kind = 3 THEN kg END, CASE WHEN kind = 3 THEN cm END, CASE WHEN kind = 4 THEN bil END, CASE WHEN kind = 4 THEN alb END, CASE WHEN kind = 4 THEN inr END, CASE WHEN kind = 4 THEN a END, CASE WHEN kind = 4 THEN e END ORDER BY event_id) AS copy FROM n),
  r AS (SELECT CASE WHEN copy > 1 THEN 'copy of a note' WHEN kind IN (2, 4) THEN 'creatinine not stated with a unit' WHEN kind = 5 THEN 'creatinine stated with different values' WHEN kind = 3 THEN 'too long' WHEN scr < 0.15e0 OR scr > 25 OR g < 2 OR g > 200 THEN 'implausible' WHEN abs(g - 30) < 3 THEN 'too close to the threshold' ELSE 'kept' END AS reason FROM k)
  SELECT x.reason, count(r.reason) AS n FROM (VALUES ('copy of a note'), ('creatinine not stated with a unit'), ('creatinine stated with different values'), ('states the derived value'), ('too long'), ('implausible'), ('too close to the threshold'), ('kept')) AS x(reason) LEFT JOIN r ON r.reason = x.reason GROUP BY 1""",
    "a43_drop_counters": "SELECT family, CASE WHEN q < 2 THEN 'low' WHEN q > 200 THEN 'high' WHEN age > 80 THEN 'old' WHEN abs(q - threshold) < 0.05e0 * threshold THEN 'near the threshold' ELSE 'kept' END AS reason, count(*) AS n FROM facts GROUP BY 1, 2",
    "f01_parse_answer": "SELECT id, variant, own AS answer FROM preds",
    "a09_own_answer_accuracy": f"SELECT variant, round({SHARE.format('own = label')}, 9) AS own_accuracy FROM preds GROUP BY variant",
    "f02_parse_label": f"WITH x AS (SELECT *, {WORD_AT.format('the')} AS a, {WORD_AT.format('of')} AS b, {WORD_AT.format('and')} AS c FROM conversations) SELECT conv_id, turn, nullif(regexp_extract(text, '\\b([ABCD])\\b', 1), '') AS letter, CASE WHEN least(a, b, c) IS NULL THEN NULL WHEN a = least(a, b, c) THEN 'the' WHEN b = least(a, b, c) THEN 'of' ELSE 'and' END AS word FROM x",
    "f03_extract_facts": """WITH k AS (SELECT event_id, event_id % 5 AS kind, event_id // 5 % 2 = 1 AS odd FROM labs) SELECT event_id, CASE WHEN kind = 0 THEN 20e0 + event_id % 60 END AS egfr, CASE WHEN kind = 1 THEN 5 + (event_id % 9) / 10e0 END AS potassium, CASE WHEN kind = 2 THEN 2 + (event_id % 10) / 10e0 END AS inr, CAST(NULL AS DOUBLE) AS qtc, 20e0 + event_id % 60 AS age,
  CASE WHEN kind = 3 THEN odd END AS pregnant, CASE WHEN kind = 4 THEN odd END AS severe_asthma, CAST(NULL AS BOOLEAN) AS clarithromycin FROM k""",
    "f04_rule_gate": """WITH k AS (SELECT event_id, event_id % 5 AS kind, event_id // 5 % 2 = 1 AS odd FROM labs) SELECT event_id, ['renal', 'potassium', 'inr', 'pregnancy', 'asthma'][kind + 1] AS rule, CASE kind WHEN 0 THEN 20 + event_id % 60 < 30 WHEN 1 THEN 5 + (event_id % 9) / 10e0 > 5.5e0 WHEN 2 THEN 2 + (event_id % 10) / 10e0 > 2.5e0 ELSE odd END AS violated FROM k""",
    "f05_mentions": f"""WITH {TRUTH} SELECT event_id, cr AS value, 'mg/dL' AS unit, 4 AS digits, cr AS mgdl FROM n WHERE kind IN (0, 3) AND cr < 10 UNION ALL SELECT event_id, cr, 'mg/dL', 5, cr FROM n WHERE kind IN (0, 3) AND cr >= 10 UNION ALL SELECT event_id, 30e0 + event_id % 400, 'umol/L', length(CAST(30 + event_id % 400 AS VARCHAR)), round(um, 9) FROM n WHERE kind = 1
  UNION ALL SELECT event_id, 1.2e0, 'mg/dL', 3, 1.2e0 FROM n, range(2) WHERE kind = 5 UNION ALL SELECT event_id, 2.9e0, 'mg/dL', 3, 2.9e0 FROM n WHERE kind = 5""",
    "f06_extract_graded": f"""WITH {TRUTH} SELECT event_id, round(scr, 9) AS creatinine_mgdl, CAST(t_age AS DOUBLE) AS age, t_sex AS sex, CASE WHEN kind = 2 THEN CAST(qt AS DOUBLE) END AS qt_ms, CASE WHEN kind = 2 THEN CAST(hr AS DOUBLE) END AS heart_rate, CASE WHEN kind = 3 THEN kg END AS weight_kg, CASE WHEN kind = 3 THEN cm END AS height_cm,
  CASE WHEN kind = 4 THEN bil END AS bilirubin, CASE WHEN kind = 4 THEN alb END AS albumin, CASE WHEN kind = 4 THEN inr END AS inr, CASE WHEN kind = 4 THEN CAST(a AS DOUBLE) END AS ascites_pts, CASE WHEN kind = 4 THEN CAST(e AS DOUBLE) END AS enceph_pts FROM n""",
    "f07_clinical_gate": f"WITH {gated(f'CASE WHEN event_id % 12 = 0 THEN {MDRD} ELSE {EPI} END')} SELECT event_id, drug, declined IS NULL AS fired, CASE WHEN declined IS NULL THEN beyond END AS violated, CASE WHEN declined IS NULL THEN round(q, 6) END AS quantity, declined FROM g",
    "a30_gate_diagnostics": f"""WITH {gated(EPI)}, w AS (SELECT drug, string_agg(declined || '=' || CAST(k AS VARCHAR), ';' ORDER BY declined || '=' || CAST(k AS VARCHAR)) AS declines FROM (SELECT drug, declined, count(*) AS k FROM g WHERE declined IS NOT NULL GROUP BY 1, 2) GROUP BY drug),
  s AS (SELECT drug, count(*) AS n, round({SHARE.format('declined IS NULL')}, 9) AS fire_rate, round(avg(CASE WHEN declined IS NULL THEN CASE WHEN (event_id % 5 < 3) = beyond THEN 1e0 ELSE 0e0 END END), 9) AS correct_when_fired, count(*) FILTER (WHERE kind < 5) AS age_read, count(*) FILTER (WHERE kind < 5) AS age_right, count(*) AS sex_read, count(*) FILTER (WHERE t_sex = sex) AS sex_right,
  count(*) FILTER (WHERE kind = 2) AS qt_ms_read, count(*) FILTER (WHERE kind = 2) AS qt_ms_right, count(*) FILTER (WHERE kind = 2) AS heart_rate_read, count(*) FILTER (WHERE kind = 2) AS heart_rate_right FROM g GROUP BY drug) SELECT s.*, w.declines FROM s LEFT JOIN w ON w.drug = s.drug""",
    "f09_states_derived": "SELECT event_id, event_id % 7 = 0 AS egfr, FALSE AS qtc, event_id % 7 = 0 AS crcl FROM labs",
    "m07_child_pugh": f"""WITH w AS (SELECT event_id, (event_id % 50) / 10e0 AS b, 2 + (event_id % 30) / 10e0 AS a, 1 + (event_id % 20) / 10e0 AS i, [1, 1, 2, 2, 3, 3, 3, NULL][event_id % 8 + 1] AS asc_, [1, 1, 2, 2, 3, 3, 3, NULL][event_id // 7 % 8 + 1] AS enc FROM labs),
  p AS (SELECT *, {B3.format('b')} AS bp, {A3.format('a')} AS ap, {B3.format('b')} + {A3.format('a')} + {I3.format('i')} + asc_ + enc AS points FROM w)
  SELECT event_id, CAST(points AS DOUBLE) AS points, """
    + ", ".join(
        f"CAST(CASE WHEN points IS NULL THEN NULL {' '.join(f'WHEN {col} <> {k} AND (points - {col} + {k} >= 10) {op} (points >= 10) THEN {v if out == 0 else f"points - {col} + {k}"}' for k, v in vals)} END AS DOUBLE) AS {name}"
        for col, vals, op, out, name in (
            ("bp", ((1, "1e0"), (2, "2.5e0"), (3, "4e0")), "<>", 0, "bilirubin_flip"),
            ("bp", ((1, ""), (2, ""), (3, "")), "=", 1, "bilirubin_control"),
            ("ap", ((1, "4.2e0"), (2, "3.15e0"), (3, "2.1e0")), "<>", 0, "albumin_flip"),
            ("ap", ((1, ""), (2, ""), (3, "")), "=", 1, "albumin_control"),
        )
    )
    + " FROM p",
    "m08_dispatch": f"WITH v AS (SELECT l.event_id, p.age, p.sex, 0.3e0 + l.value / 40e0 AS scr, 45e0 + l.event_id % 60 AS kg, 150e0 + l.event_id % 45 AS cm FROM labs l JOIN patients p ON p.sid = l.sid) SELECT event_id, ['cockcroft_gault', 'mdrd', 'ckd_epi'][event_id % 3 + 1] AS kind, round(CASE event_id % 3 WHEN 0 THEN {CG} WHEN 1 THEN {MDRD} ELSE {EPI} END, 6) AS v FROM v",
    "p14_justification": "SELECT id, variant, CASE WHEN own = 'UNSAFE' AND raw LIKE 'Unsafe%' THEN 'the threshold is crossed.' ELSE raw END AS why FROM preds",
    "f12_section_excerpt": r"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(chr(10) || text || chr(10) || 'Discharge Medications:' || chr(10) || 'none', '(?s)\n[\s\x0b]*[A-Z][A-Za-z /&#-]{2,60}:[\s\x0b]*\n.*$', ''), '[ \t]+', ' ', 'g'), '^[\s\x0b\x85\xA0\x{2000}-\x{200A}\x{3000}]+|[\s\x0b\x85\xA0\x{2000}-\x{200A}\x{3000}]+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN length(body) < 200 THEN NULL WHEN length(body) <= 400 THEN body ELSE coalesce(nullif(regexp_extract(substr(body, 1, 400), '(?s)^(.*[.!?])[\s\x0b]', 1), ''), substr(body, 1, 400)) END AS excerpt, CASE WHEN length(body) < 200 THEN 'too short' END AS reason FROM b""",
    "f13_sentences": f"SELECT doc_id, len(s) AS n, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents WHERE text IS NOT NULL) WHERE len(s) > 0",
    "f14_number_sentences": f"WITH s AS (SELECT doc_id, lang, {SENTENCES.format('text')} AS s FROM documents), x AS (SELECT doc_id, lang, s, unnest(range(0, least(5, len(s)))) AS place FROM s) SELECT doc_id, lang, place, sha256(s[place + 1]) AS sentence, regexp_matches(s[place + 1], '[0-9]') AS has_number FROM x",
    "f15_evidence": f"WITH {FOUND} SELECT family, section, value, CAST(length(context) AS DOUBLE) AS context_chars FROM found",
    "f16_attestation": f"WITH {FOUND} SELECT family, status FROM found",
    "j21_containment": f"""WITH {FOUND}, s AS (SELECT drug, section, seq, {SENTENCES.format('text')} AS s FROM lab), r AS (SELECT drug, section, seq, s, unnest(range(0, len(s))) AS place FROM s), m AS (SELECT r.drug || '/' || r.section || '/' || CAST(seq AS VARCHAR) || '/' || CAST(place AS VARCHAR) AS row, f."order", f.family, f.status FROM r JOIN found f ON f.drug = r.drug AND f.section = r.section AND f.status LIKE 'attested%' AND (contains(f.context, substr(s[place + 1], 1, 60)) OR contains(s[place + 1], substr(f.context, 1, 60))))
  SELECT row, arg_min(family, "order") AS family, arg_min(status, "order") AS status FROM m GROUP BY row""",
    "a54_provenance_rollup": f"WITH {FOUND}, o AS (SELECT family, status, CASE status WHEN 'attested_exact' THEN 0 WHEN 'attested_qualitative' THEN 1 WHEN 'construct_mismatch' THEN 2 WHEN 'absent' THEN 3 ELSE 9 END AS r FROM found) SELECT family, status, row_number() OVER (ORDER BY r, family) AS place, count(*) FILTER (WHERE status IN ('attested_exact', 'attested_different_value')) OVER () AS n_attested, count(*) OVER () AS n_families FROM o",
    "f17_concept_matcher": f"WITH m AS (SELECT doc_id, regexp_extract_all({_DOUBLED}, '{_matched(_WORDS['definite'][0])}', 1) AS m FROM documents) SELECT doc_id, len(m) AS hits, CAST(coalesce(list_sum(list_transform(m, lambda x: length(replace(x, '  ', ' ')))), 0) AS BIGINT) AS chars FROM m",
    "a50_concept_hits": f"SELECT lang, concept, CAST(sum(f) AS BIGINT) AS \"full\", CAST(sum(b) AS BIGINT) AS bare FROM ({HITS}) GROUP BY 1, 2",
    "p16_provenance": f"WITH h AS (SELECT concept, sum(f) AS f, sum(b) AS b FROM ({HITS}) GROUP BY concept) SELECT concept, CASE WHEN concept IN ('letters', 'single') THEN 'lexical' WHEN f = 0 THEN 'unmeasurable' WHEN b = 0 THEN 'anchored only' WHEN b < f / 2 THEN 'mostly curated' ELSE 'matched' END AS state FROM h",
    "f18_norm_atom": r"SELECT conv_id, turn, sha256(trim(regexp_replace(lower(regexp_replace(text, '\[[^\]]*\]', ' ', 'g')), '[\s\x0b\x85\xA0\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+', ' ', 'g'))) AS atom FROM conversations WHERE text IS NOT NULL",
    "f21_word_presence": "SELECT id, variant, CASE WHEN own IS NULL THEN '' WHEN own = 'SAFE' THEN 'SAFE' WHEN raw LIKE 'Unsafe%' THEN 'UNSAFE' ELSE 'SAFE' END AS words FROM preds",
    "f25_age_phrase": "SELECT sid, age, 'goes to ' || CASE WHEN age <= 11 THEN 'primary' ELSE 'secondary' END || ' school, year ' || CAST(greatest(1, age - 5) AS VARCHAR) AS phrase FROM (SELECT sid, age % 14 + 4 AS age FROM patients)",
    "f27_tfidf": f"WITH {cosine('benchmark', 'item_id', 'benchmark', 'item_id')} SELECT k AS item_id, count(*) AS terms, round(max(w), 6) AS top, round(sum(w), 6) AS total FROM cv GROUP BY k",
    "j15_tfidf_top_k": f"WITH {cosine('benchmark', 'item_id', 'documents', 'doc_id')} SELECT qk AS doc_id, rank, ck AS item_id, round(score, 6) AS score FROM top",
    "a29_retrieval_hits": f"""WITH {PROMPTS}, {cosine('corpus', 'id', 'prompts', 'no')}, got AS (SELECT qk, list(ck ORDER BY rank) AS names FROM top GROUP BY qk), j AS (SELECT p.family, coalesce(p.pred = p.label, FALSE) AS ok, nullif(list_position(g.names, 'guideline::' || p.family), 0) AS place, len(list_filter(g.names, lambda x: x LIKE 'distractor::%')) AS bad, len(g.names) AS slots FROM preds p JOIN prompts q ON q.text = p.prompt JOIN got g ON g.qk = q.no WHERE p.variant = 'rag'),
  b AS (SELECT * FROM j UNION ALL SELECT 'POOLED', ok, place, bad, slots FROM j) SELECT family, count(*) AS n, {HITS_BY}, round(avg(place), 9) AS mean_rank, round({SHARE.format('coalesce(place <= 3, FALSE)')} / 3, 9) AS precision_at_k, round(sum(bad) / CAST(sum(slots) AS DOUBLE), 9) AS distractor_share, round({SHARE.format('ok')}, 9) AS accuracy,
  round(avg(CASE WHEN place IS NOT NULL THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END), 9) AS accuracy_hit, round(avg(CASE WHEN place IS NULL THEN CASE WHEN ok THEN 1e0 ELSE 0e0 END END), 9) AS accuracy_miss FROM b GROUP BY family""",
    "j16_dictionary_match": "WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings) SELECT a.vec_id AS x, b.vec_id AS y, round(abs(list_inner_product(a.v, b.v)), 6) AS c FROM u a JOIN u b ON a.label % 2 = 0 AND b.label % 2 = 1 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(abs(list_inner_product(a.v, b.v)), 6) DESC, b.vec_id DESC) = 1",
    "g01_graph_build": f"WITH {CLAIMS} SELECT cui, kind, array_to_string(atom_keys, '|') AS atom_keys FROM nodes",
    "g02_contraindications": f"WITH {CLAIMS} SELECT src, dst, max(provenance) AS provenance, arg_max(source, provenance) AS source, count(*) AS edges FROM edges WHERE rel = 'CONTRAINDICATED_WITH' GROUP BY 1, 2",
    "g03_mechanisms": f"WITH {CLAIMS} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), '|') AS annotations FROM edges WHERE rel LIKE 'HAS%' GROUP BY src",
    "g04_attestation": f"WITH {ATTESTED} SELECT * FROM states",
    "a39_graph_coverage": f"WITH {ATTESTED}, f AS (SELECT source, bool_or(state <> 'curated') AS ok FROM states GROUP BY source) SELECT count(*) AS n_families, count(*) FILTER (WHERE ok) AS n_attested, round({SHARE.format('ok')}, 9) AS fraction FROM f",
    "m15_ontology_margin": f"""WITH {ATTESTED} SELECT d.cui AS src, f.cui AS dst, CASE WHEN NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = d.cui AND e.dst = f.cui AND e.rel = 'CONTRAINDICATED_WITH') THEN 0e0 WHEN EXISTS (SELECT 1 FROM contra u WHERE u.src = d.cui AND u.dst = f.cui) OR EXISTS (SELECT 1 FROM states s WHERE s.src = d.cui AND s.dst = f.cui AND s.state <> 'curated') THEN 2.5e0 ELSE 2e0 END AS margin
  FROM nodes d CROSS JOIN nodes f WHERE d.kind = 'drug' AND f.cui LIKE 'F:%'""",
    "g05_layered_build": f"WITH {CLAIMS} SELECT src, dst, rel, provenance, source FROM edges",
    "g06_round_trip": f"WITH {CLAIMS} SELECT src, dst, rel, provenance, source FROM edges UNION ALL SELECT cui, '', kind, array_to_string(atom_keys, '|'), cui FROM nodes",
    "j19_edge_preference": f"WITH {CLAIMS} SELECT src, dst, rel, provenance, source FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY CASE provenance WHEN 'umls' THEN 0 ELSE 1 END, dst, rel) = 1",
    "j20_set_overlap": f"WITH {CLAIMS_BY_SIZE} SELECT a.cui AS x, b.cui AS y, len(list_intersect(a.atom_keys, b.atom_keys)) AS shared FROM nodes a JOIN nodes b ON a.cui < b.cui AND list_has_any(a.atom_keys, b.atom_keys)",
    "a38_concept_jaccard": "WITH s AS (SELECT source, list(DISTINCT lang || '/' || CAST(n_chars - n_chars % 1000 AS VARCHAR)) AS m FROM documents GROUP BY source) SELECT a.source AS x, b.source AS y, round(len(list_intersect(a.m, b.m)) / CAST(len(list_distinct(list_concat(a.m, b.m))) AS DOUBLE), 9) AS jaccard, len(a.m) - len(list_intersect(a.m, b.m)) AS only_x, len(b.m) - len(list_intersect(a.m, b.m)) AS only_y FROM s a JOIN s b ON a.source < b.source AND list_has_any(a.m, b.m)",
    "a40_aopc": f"WITH {EFFECTS}, h AS (SELECT pair_id, layer, avg(abs(delta)) AS h FROM eff GROUP BY 1, 2), p AS (SELECT layer, pair_id, i, 0.9e0 - 0.9e0 / (1 + h * (i + 2) / 10e0) AS c, 0.9e0 - 0.9e0 / (1 + h * i / 10e0) AS s FROM h CROSS JOIN range(1, 5) AS g(i)) SELECT layer, count(DISTINCT pair_id) AS n, round(avg(c), 9) AS aopc_comprehensiveness, round(avg(s), 9) AS aopc_sufficiency FROM p GROUP BY layer",
    "a52_perplexity": "SELECT lang, round(exp(sum((1e0 + (doc_id % 100) / 100e0) * n_chars) / (sum(n_chars) + 1)), 6) AS ppl FROM documents GROUP BY lang",
    "m10_scalars": "SELECT item_no, variant, round(greatest(0e0, least(1e0, logit_margin / 4e0)), 6) AS clipped, round(1e0 / (1e0 + exp(-logit_margin)), 6) AS sigmoid, round(ln(abs(logit_margin) + 1e0), 6) AS log FROM preds WHERE logit_margin IS NOT NULL",
    "m13_sparsify": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), t AS (SELECT vec_id, list_filter(list_sort(v, 'DESC')[1:8], lambda x: x > 0) AS t, list_filter(v, lambda x: x > exp(-2e0)) AS g FROM e) SELECT vec_id, len(t) AS top_live, round(coalesce(list_sum(t), 0e0), 6) AS top_sum, len(g) AS gated_live, round(coalesce(list_sum(g), 0e0), 6) AS gated_sum FROM t",
    "m14_kind_map": "WITH e AS (SELECT ['T999', 'T047', 'T121'][event_id % 3 + 1] AS a, ['T059', 'T033', 'T998', 'T044', 'T195'][event_id % 5 + 1] AS b, event_id % 8 AS r FROM events), k AS (SELECT CASE a WHEN 'T047' THEN 'disease' WHEN 'T121' THEN 'drug' ELSE CASE b WHEN 'T059' THEN 'lab' WHEN 'T033' THEN 'finding' WHEN 'T044' THEN 'process' WHEN 'T195' THEN 'drug' ELSE 'other' END END AS kind, ['CONTRAINDICATED_WITH', 'MAY_TREAT', 'MAY_PREVENT', 'HAS_PHYSIOLOGIC_EFFECT', 'HAS_MECHANISM', 'HAS_PHARMACOKINETICS', 'INDUCES', NULL][r + 1] AS edge FROM e) SELECT kind, edge, count(*) AS n FROM k GROUP BY 1, 2",
    "t06_edge_dedup": "SELECT p_brand AS src, p_type AS dst, 'COMES_AS' AS rel, 'size ' || CAST(p_size % 5 AS VARCHAR) AS provenance FROM part GROUP BY 1, 2, 3, 4",
    "p03_dynamic_predicate": "SELECT e.event_id, r.family, CASE r.op WHEN '<' THEN e.value < r.threshold WHEN '>' THEN e.value > r.threshold END AS holds FROM rules r LEFT JOIN labs e ON e.item = r.item",
    "p09_option_swap": "SELECT id, string_split(prompt, 'Is it safe')[1] || 'Is it unsafe or safe' || string_split(prompt, 'Is it safe')[2] AS swapped FROM items",
    "p10_redact": "SELECT id, CASE item_no % 3 WHEN 0 THEN regexp_replace(prompt, 'value [0-9]+', 'value [not recorded]') WHEN 1 THEN 'Level [not recorded]; level ' || CAST(CAST(round(factor_value) AS BIGINT) AS VARCHAR) || ' units before.' END AS redacted FROM items",
    "p11_adapt": "SELECT replace(id || '|', '|', '__note') AS id, pair_id || '__note' AS pair_id, 'note' AS presentation, label FROM items",
    "m01_ckd_epi": f"WITH v AS (SELECT l.event_id, p.age, p.sex, 0.3e0 + l.value / 40e0 AS scr FROM labs l JOIN patients p ON p.sid = l.sid) SELECT event_id, round({EPI}, 6) AS egfr FROM v",
    "f19_label_from_prompt": f"WITH v AS (SELECT i.id, i.factor_value, r.convert, r.op, r.threshold, p.age, p.sex, 0.3e0 + i.factor_value / 40e0 AS scr FROM items i JOIN rules r ON r.family = i.family JOIN patients p ON p.sid = i.sid), q AS (SELECT *, CASE WHEN convert = 'ckd_epi' THEN {EPI} ELSE factor_value END AS q FROM v) SELECT id, factor_value AS shown, CAST(2 AS BIGINT) AS decimals, CASE WHEN CASE op WHEN '<' THEN q < threshold ELSE q > threshold END THEN 'UNSAFE' ELSE 'SAFE' END AS label FROM q",
    "f20_rederivation": "SELECT 'item' AS part, family AS name, count(*) AS n, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM items GROUP BY family UNION ALL SELECT 'decision', variant, count(*), 0, 0, 0 FROM preds GROUP BY variant",
    "f22_truncate_words": r"WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, CASE WHEN len(w) <= 12 THEN text ELSE array_to_string(w[1:12], ' ') || ' ...' END AS cut FROM w",
    "s22_corpus": r"SELECT 'guideline::' || family AS id, 'Threshold for ' || family AS text FROM rules UNION ALL SELECT 'distractor::' || CAST(item_id AS VARCHAR), text FROM benchmark UNION ALL SELECT 'label::' || CAST(doc_id AS VARCHAR), substr(s, 1, 1200) FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS s FROM documents WHERE text IS NOT NULL) WHERE length(s) >= 80",
    "s11_adapters": """WITH n AS (SELECT chr(10) AS nl), a AS (SELECT 'parts' AS source, p_partkey, 'Which?' || nl || trim(p_name) || nl || 'A. ' || p_brand || nl || 'B. ' || p_type || nl || 'C. ' || p_name || nl || 'D. ' || p_brand || nl || 'Answer:' AS prompt, 'A|B|C|D' AS labels, ['A', 'B', 'C', 'D'][p_partkey % 4 + 1] AS gold, '{"size":"' || CAST(p_size AS VARCHAR) || '"}' AS meta FROM part, n),
  b AS (SELECT 'maps' AS source, p_partkey, CASE WHEN len(w) <= 3 THEN trim(p_name) ELSE array_to_string(w[1:3], ' ') || ' ...' END || nl || 'A. one' || nl || 'B. two' || nl || CASE WHEN p_partkey % 2 = 0 THEN 'C. three' || nl ELSE '' END || 'D. four' AS prompt, 'A|B|C|D', CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'D' END, '{}' FROM (SELECT *, list_filter(regexp_split_to_array(p_name, '[\\s]+'), lambda x: x <> '') AS w FROM part), n),
  t AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS c FROM conversations GROUP BY 1), u AS (SELECT *, list_filter(regexp_split_to_array(c, '[\\s\\x0b\\x1c-\\x1f\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS w FROM t),
  d AS (SELECT 'talks', conv_id, CASE WHEN len(w) <= 12 THEN c ELSE array_to_string(w[1:12], ' ') || ' ...' END || nl || 'Q: Is it so?', 'yes|no|maybe', ['yes', 'no', 'maybe'][conv_id % 3 + 1], '{}' FROM u, n)
  SELECT source, source || '::' || CAST(p_partkey AS VARCHAR) AS id, sha256(prompt) AS prompt, labels, gold, meta FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d) AS x""",
    "a23_conflicts": "WITH c AS (SELECT prompt, string_agg(DISTINCT family, '+' ORDER BY family) AS family, count(*) AS n FROM items GROUP BY prompt HAVING count(DISTINCT label) > 1) SELECT family, count(*) AS prompts, CAST(sum(n) AS BIGINT) AS n_items, round(sum(n) / CAST((SELECT count(*) FROM items) AS DOUBLE), 9) AS share FROM c GROUP BY family",
    "j08_anti_joins": "WITH p0 AS (SELECT id FROM preds WHERE variant = 'base' AND h2 % 13 <> 0 UNION ALL SELECT id || 'x' FROM items WHERE item_no % 30 = 0), p AS (SELECT id FROM p0 UNION ALL SELECT id FROM p0 WHERE id LIKE '%0_safe') SELECT 'missing' AS kind, count(*) AS n FROM items i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = i.id) UNION ALL SELECT 'extra', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.id = p.id) UNION ALL SELECT 'repeated', count(*) - count(DISTINCT id) FROM p",
    "j22_artifact_diff": f"""WITH o AS (SELECT family, CASE WHEN family <> 'high' THEN round({SHARE.format('correct')}, 6) END AS m FROM preds WHERE variant = 'base' AND family <> 'held' GROUP BY family), n AS (SELECT family, CASE WHEN family <> 'high' THEN round({SHARE.format('correct')}, 6) END AS m FROM preds WHERE variant = 'rag' GROUP BY family)
  SELECT coalesce(o.family, n.family) AS family, CASE WHEN o.m IS NULL AND n.m IS NULL THEN 'both missing' WHEN o.m IS NULL THEN 'no baseline' WHEN n.m IS NULL THEN 'not re-run' WHEN abs(o.m - n.m) <= 1e-9 THEN 'identical' ELSE 'changed' END AS status, round(n.m - o.m, 6) AS delta FROM o FULL OUTER JOIN n ON n.family = o.family""",
    "j24_moved_rows": f"""WITH r AS (SELECT variant, item_no % 5 AS layer, family, round({SHARE.format('correct')}, 6) AS m, count(pred) AS used FROM preds WHERE variant IN ('base', 'rag') GROUP BY 1, 2, 3) SELECT a.layer, a.family, round(b.m - a.m, 6) AS change, a.used = b.used AS comparable FROM r a JOIN r b ON a.layer = b.layer AND a.family = b.family AND a.variant = 'base' AND b.variant = 'rag' WHERE abs(a.m - b.m) > 1e-9 AND a.layer <> (SELECT max(layer) FROM r WHERE variant = 'base')""",
    "o04_patient_split": "WITH h AS (SELECT sid, row_number() OVER (ORDER BY (sid * 2654435761) % 1000003, sid) AS rn, count(*) OVER () AS n FROM patients) SELECT sid, CASE WHEN rn <= greatest(1, floor(n * 0.5e0 + 1e-9)) THEN 'test' WHEN rn <= floor(n * 0.7e0 + 1e-9) THEN 'calib' ELSE 'train' END AS split FROM h",
    "o05_pair_split": "WITH h AS (SELECT pair_id, row_number() OVER (PARTITION BY held_out ORDER BY (no * CASE WHEN held_out THEN 40503 ELSE 97531 END) % 1000003, pair_id) AS rn, count(*) OVER (PARTITION BY held_out) AS n FROM (SELECT pair_id, held_out, min(item_no) AS no FROM items WHERE NOT is_control GROUP BY pair_id, held_out)) SELECT pair_id, CASE WHEN rn <= greatest(1, floor(n * 0.5e0 + 1e-9)) THEN 'test' WHEN rn <= floor(n * 0.7e0 + 1e-9) THEN 'calib' ELSE 'train' END AS split FROM h",
    "o08_repeats_and_order": "WITH i AS (SELECT id, row_number() OVER (ORDER BY item_no * 97531 % 1000003, id) AS rn, count(*) OVER () AS n FROM items), p AS (SELECT id, NULL AS repeat_of FROM i UNION ALL SELECT id || 'R', id FROM i WHERE rn <= greatest(1, round_even(n * 0.1e0, 0))) SELECT r.rater, p.id, p.repeat_of, sha256(r.rater || '|' || p.id) AS order_hash FROM p CROSS JOIN (VALUES ('rater1'), ('rater2')) AS r(rater)",
}
ORACLE_SQL = {name: with_base(text) for name, text in SQL.items()}

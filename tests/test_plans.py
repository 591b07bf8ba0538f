"""Every query against the checking engine, the base tables first, and planted defects that audits must find."""

import duckdb
import numpy as np
import pytest

from counterlens.operators import audits, causal_graph, cohort, render
from counterlens.plans import catalogue, registry
from counterlens.plans.base_sql import BASE

DATA = "/root/testdata/sf0.001"
DERIVED = ["patients", "labs", "rules", "variants", "facts", "items", "preds"]
ROWS_ONLY = [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL]


def rows(df):
    cols = sorted(df.columns)
    show = lambda v: repr(round(float(v), 7) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else str(v)
    return sorted(tuple(map(show, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("table", DERIVED)
def test_base_tables(spark, base, table):
    got, want = registry.Tables(spark, DATA)[table].toPandas(), base.sql(f"WITH {BASE} SELECT * FROM {table}").df()
    cols = [c for c in got.columns if c in want.columns]
    assert len(cols) >= 3 and len(got) > 0 and rows(got[cols]) == rows(want[cols])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, base, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), base.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_queries_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


#: Two parts that curate a finding each, and one of the ontology, that shares with the first the class of its size but is far in keys.
FAR_PARTS = [(300, "fam", "B1", "X", 7), (600, "fam2", "B2", "Y", 1), (1201, "n1", "B1", "Z", 14)]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("g04_attestation", [("B1", "F:X", "fam", "synonymous", "T:n1", 1), ("B2", "F:Y", "fam2", "curated", None, 0)]),
        ("a39_graph_coverage", [(2, 1, 0.5)]),
        ("m15_ontology_margin", [("B1", "F:X", 2.5), ("B1", "F:Y", 0.0), ("B2", "F:X", 0.0), ("B2", "F:Y", 2.0)]),
        ("j20_set_overlap", [("F:X", "T:n1", 1)]),
    ],
)
def test_graph_of_keys_that_many_parts_share(spark, tmp_path, name, want):
    spark.createDataFrame(FAR_PARTS, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == want


def test_overlaps_of_concepts_against_a_loop(spark):
    """Every pair once, with all that it shares: more than one key, hot keys, equal sets, missing keys and none."""
    nodes = [(f"c{i}", sorted({f"k{i % 2}", f"m{i % 7}", f"o{i}"}) + [None]) for i in range(60)] + [("none", []), ("null", None), ("only", [None])]
    got = [tuple(r) for r in causal_graph.overlaps(spark.createDataFrame(nodes, causal_graph.NODE.replace("name string, kind string, ", "")), deals=3).collect()]
    sets = {c: set(k or []) - {None} for c, k in nodes}
    assert sorted(got) == sorted((x, y, len(sets[x] & sets[y])) for x in sets for y in sets if x < y and sets[x] & sets[y])


def test_views_of_the_session_are_left_alone(spark):
    spark.range(3).createOrReplaceTempView("items")
    catalogue.QUERIES["a25_representative_pair"](spark, DATA).count()
    assert spark.table("items").count() == 3 and not [t for t in spark.catalog.listTables() if t.name.startswith("_view_")]
    spark.catalog.dropTempView("items")


def test_planted_defects_are_found(spark):
    """A crossing control, a pair of one arm, a changed label, a conflict, an extra and a missing prediction, a leaked text."""
    items = registry.Tables(spark, DATA)["items"]
    one = items.where("NOT is_control").limit(1).first()
    flip = lambda where: items.selectExpr(*[f"CASE WHEN {where} THEN CASE label WHEN 'SAFE' THEN 'UNSAFE' ELSE 'SAFE' END ELSE label END AS label" if c == "label" else c for c in items.columns])
    states = lambda df: {r.state: r.pairs for r in audits.pair_census(df, []).collect()}
    assert set(states(items)) <= {"complete", "control"}
    assert states(flip(f"id = '{one.id}'"))["labels agree"] == 1
    assert states(items.where(f"id <> '{one.id}'"))["incomplete"] == 1
    control = items.where("is_control").limit(1).first()
    assert states(flip(f"id = '{control.id}'"))["control crosses"] == 1
    twice = items.unionByName(flip("TRUE").where(f"id = '{one.id}'"))
    assert audits.conflicts(twice, "prompt", "label", "family").groupBy().sum("prompts").first()[0] >= 1
    kinds = {r.kind: r.n for r in audits.id_match(items, items.where(f"id <> '{one.id}'").select("id").unionByName(spark.createDataFrame([("new",), (control.id,)], "id string")), "id").collect()}
    assert kinds == {"missing": 1, "extra": 1, "repeated": 1}
    texts = spark.createDataFrame([("a", "test"), ("a", "train"), ("a", "train"), ("b", "test"), (None, "test"), (None, "train")], "x string, s string")
    assert [tuple(r) for r in audits.shared_between_splits(texts, "x", "s").collect()] == [("test", "train", 1)]


def test_alignment_refuses_what_does_not_match(spark):
    left, right = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean"), spark.createDataFrame([(1, True), (3, False)], "id int, ok boolean")
    with pytest.raises(Exception, match="not one row on each side"):
        audits.aligned(left, right, "id", {"ok": "other"}).collect()
    assert audits.aligned(left, left, "id", {"ok": "other"}).count() == 2


def test_arms_of_a_pair_have_one_skeleton(spark):
    rows_ = catalogue.QUERIES["p08_family_render"](spark, DATA).join(registry.Tables(spark, DATA)["items"].select("id", "pair_id"), "id")
    same = rows_.groupBy("pair_id").count().where("count = 2")
    assert same.count() > 0
    mixed = render.minimal_pairs(rows_.join(same, "pair_id"))
    # an explicit and an implicit arm are no minimal pair, and are told
    presentations = registry.Tables(spark, DATA)["items"].groupBy("pair_id").agg({"presentation": "min"}).count()
    assert mixed.count() < presentations


def test_top_k_searches_every_row(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    v = np.array(e.embedding.tolist(), float)
    want = set()
    for q in np.flatnonzero(e.vec_id % 20 == 0):
        sim = (v @ v[q]).round(6)
        want |= {(int(e.vec_id[q]), int(e.vec_id[i])) for i in np.lexsort((-e.vec_id, -sim))[:3]}
    got = catalogue.QUERIES["o01_top_k_retrieval"](spark, DATA).collect()
    assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == len(want)


def test_variants_are_calibrated_on_their_own_split(spark):
    rows_ = [("v", "calib", True, False, "A" if i < 80 else "B", "A", i / 100) for i in range(100)] + [("v", "test", True, False, "A", "A", u) for u in (0.5, 0.99, None)]
    out = cohort.run_variants(spark.createDataFrame(rows_, "variant string, split string, uq boolean, gate_fired boolean, pred string, label string, u double").withColumn("abstained", cohort.F.lit(False)).withColumn("correct", cohort.F.lit(False)))
    assert [r.abstained for r in out.where("split = 'test'").orderBy(cohort.F.col("u").asc_nulls_last()).collect()] == [False, True, True]

"""A graph of concepts and typed edges with provenance, as two tables.

nodes: cui, name, kind, atom_keys (array of normalised surface forms). edges: src, dst,
rel, provenance (curated or umls), source. All questions are about one hop, so they are
joins on concepts; none walks paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterlens.sources import files

AGAINST = "CONTRAINDICATED_WITH"
MECHANISMS = ("HAS_PHYSIOLOGIC_EFFECT", "HAS_MECHANISM")
NODE = "cui string, name string, kind string, atom_keys array<string>"
EDGE = "src string, dst string, rel string, provenance string, source string"


def nodes(mentions: DataFrame) -> DataFrame:
    """One node a concept of (cui, name, kind, atoms, seen): what is seen first (of equals the smallest) names it, the first non-empty atoms are its keys."""
    first = lambda c: F.min(F.struct("seen", c))[c]
    keys = F.when(F.size(F.coalesce("atoms", F.array())) > 0, F.struct("seen", F.array_sort(F.array_distinct("atoms")).alias("keys")))
    by = mentions.where("cui IS NOT NULL").groupBy("cui").agg(first("name").alias("name"), first("kind").alias("kind"), F.min(keys).alias("_keys"))
    return by.select("cui", "name", "kind", F.coalesce("_keys.keys", F.array().cast("array<string>")).alias("atom_keys"))


def edges(claims: DataFrame) -> DataFrame:
    """One edge of each (src, dst, rel, provenance) of (.., source, seen): the first seen stays."""
    whole = claims.where("src IS NOT NULL AND dst IS NOT NULL")
    return whole.groupBy("src", "dst", "rel", "provenance").agg(F.min(F.struct("seen", "source"))["source"].alias("source"))


def contraindications(graph_edges: DataFrame) -> DataFrame:
    """src, dst and the edge that stands for them, of the ontology where it has one."""
    rank = F.when(F.col("provenance") == "umls", 0).otherwise(1)
    by = graph_edges.where(F.col("rel") == AGAINST).groupBy("src", "dst").agg(F.min(F.struct(rank.alias("rank"), "provenance", "source")).alias("e"), F.count("*").alias("edges"))
    return by.select("src", "dst", "e.provenance", "e.source", "edges")


def mechanisms(graph_edges: DataFrame) -> DataFrame:
    """Effects and mechanisms that the ontology gives a drug: annotations, not a path to any finding."""
    return graph_edges.where(F.col("rel").isin(*MECHANISMS)).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("annotations"))


def attestation(graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """src, dst, source of every curated contraindication, with state, the concept that attests it, and how many the ontology has for src.

    exact: the ontology asserts it of the same concept; synonymous: of one that shares a
    surface form (the smallest is named); curated: of none.
    """
    curated = graph_edges.where((F.col("rel") == AGAINST) & (F.col("provenance") == "curated")).select("src", "dst", "source")
    known = graph_edges.where((F.col("rel") == AGAINST) & (F.col("provenance") == "umls")).select("src", F.col("dst").alias("target")).distinct()
    keys = graph_nodes.select("cui", F.explode("atom_keys").alias("key"))
    # pairs of concepts that share a key are found by the key, so no two lists are compared
    own = curated.join(keys, F.col("dst") == F.col("cui")).select("src", "dst", "source", "key")
    theirs = known.join(keys, F.col("target") == F.col("cui")).select("src", "target", "key")
    shared = own.join(theirs, ["src", "key"]).groupBy("src", "dst", "source").agg(F.min("target").alias("synonym"))
    exact = known.withColumnRenamed("target", "dst").withColumn("exact", F.lit(True))
    counts = known.groupBy("src").agg(F.count("*").alias("n_ontology"))
    out = curated.join(exact, ["src", "dst"], "left").join(shared, ["src", "dst", "source"], "left").join(counts, "src", "left")
    state = F.when(F.col("exact"), "exact").when(F.col("synonym").isNotNull(), "synonymous").otherwise("curated")
    matched = F.when(F.col("exact"), F.col("dst")).otherwise(F.col("synonym"))
    return out.select("src", "dst", "source", state.alias("state"), matched.alias("matched"), F.coalesce("n_ontology", F.lit(0)).alias("n_ontology"))


def overlaps(graph_nodes: DataFrame, deals: int = 16) -> DataFrame:
    """x, y (x < y) and how many surface forms they share, of all pairs of concepts that share any.

    A pair meets under each of its common keys and stays under the smallest, so pairs are
    never gathered; the concepts of one key are dealt to ``deals`` tasks.
    """
    forms = graph_nodes.select("cui", F.array_compact("atom_keys").alias("keys")).select("cui", "keys", F.explode("keys").alias("key"))
    x = forms.select("key", F.col("cui").alias("x"), F.col("keys").alias("x_keys"), F.pmod(F.hash("cui"), F.lit(deals)).alias("deal"))
    y = forms.select("key", F.col("cui").alias("y"), F.col("keys").alias("y_keys"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    met = x.join(y, ["key", "deal"]).where("x < y").withColumn("common", F.array_intersect("x_keys", "y_keys"))
    return met.where(F.col("key") == F.array_min("common")).select("x", "y", F.size("common").cast("long").alias("shared"))


def coverage(attested: DataFrame) -> DataFrame:
    """Families, how many the ontology attests, and their share."""
    by = attested.groupBy("source").agg(F.bool_or(F.col("state") != "curated").alias("ok"))
    return by.agg(F.count("*").alias("n_families"), F.count_if("ok").alias("n_attested"), F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)).alias("fraction"))


def margins(pairs: DataFrame, graph_edges: DataFrame, attested: DataFrame, base: Column | float = 1.0) -> DataFrame:
    """``pairs`` (src, dst) with the margin that the graph asks for: 0 without a contraindication, a quarter more where the ontology attests it."""
    base = base if isinstance(base, Column) else F.lit(float(base))
    edge = contraindications(graph_edges).select("src", "dst", F.lit(True).alias("_edge"), (F.col("provenance") == "umls").alias("_umls"))
    sure = attested.where("state <> 'curated'").select("src", "dst").distinct().withColumn("_sure", F.lit(True))
    out = pairs.join(edge, ["src", "dst"], "left").join(sure, ["src", "dst"], "left")
    wide = F.coalesce("_sure", F.lit(False)) | F.coalesce("_umls", F.lit(False))
    return out.withColumn("margin", F.when(F.col("_edge").isNull(), 0.0).otherwise(base * F.when(wide, 1.25).otherwise(1.0))).drop("_edge", "_umls", "_sure")


def build(curated: DataFrame, ontology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges in two stages: curated claims (drug, finding, family, atoms), then what the ontology says of those drugs.

    ``ontology`` has drug, target, rel, atoms; its claims about other drugs, or of
    relations that are no edges, are left out. Atoms of targets count for
    contraindications only.
    """
    named = F.col("finding").isNotNull() & F.col("drug").isNotNull()
    stage_a = curated.where(named)
    kept = ontology.join(stage_a.select("drug").distinct(), "drug", "left_semi").where("rel IS NOT NULL AND target IS NOT NULL")
    none = F.array().cast("array<string>")
    mention = lambda df, cui, kind, atoms, seen: df.select(F.col(cui).alias("cui"), F.col(cui).alias("name"), kind.alias("kind"), atoms.alias("atoms"), F.lit(seen).alias("seen"))
    ill = F.when(F.col("rel").isin(AGAINST, "MAY_TREAT", "MAY_PREVENT"), "disease").otherwise("process")
    seen = mention(stage_a, "drug", F.lit("drug"), none, 0).unionByName(mention(stage_a, "finding", F.lit("disease"), F.col("atoms"), 1))
    seen = seen.unionByName(mention(kept, "target", ill, F.when(F.col("rel") == AGAINST, F.col("atoms")).otherwise(none), 2))
    claims = stage_a.select(F.col("drug").alias("src"), F.col("finding").alias("dst"), F.lit(AGAINST).alias("rel"), F.lit("curated").alias("provenance"), F.col("family").alias("source"), F.col("family").alias("seen"))
    claims = claims.unionByName(kept.select(F.col("drug").alias("src"), F.col("target").alias("dst"), "rel", F.lit("umls").alias("provenance"), F.lit("MED-RT").alias("source"), F.lit("").alias("seen")))
    return nodes(seen), edges(claims)


def round_trip(spark: SparkSession, graph_nodes: DataFrame, graph_edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph written as JSON lines and read back under its schema."""
    graph_nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph_edges.write.mode("overwrite").json(f"{path}/edges")
    return files.read_jsonl(spark, f"{path}/nodes", NODE), files.read_jsonl(spark, f"{path}/edges", EDGE)


def preferred(graph_edges: DataFrame) -> DataFrame:
    """The edge of each src that goes first: of the ontology, then by name."""
    order = Window.partitionBy("src").orderBy(F.when(F.col("provenance") == "umls", 0).otherwise(1), "dst", "rel")
    return graph_edges.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


# Semantic types by the kind of node they make, and relations of the ontology by the edge they make.
KINDS = {"drug": "T109 T110 T121 T125 T129 T195 T200", "disease": "T019 T020 T037 T046 T047 T191", "finding": "T032 T033 T184", "process": "T039 T040 T042 T043 T044 T045", "lab": "T034 T059 T060 T201"}
EDGES = {"contraindicated_with_disease": "CONTRAINDICATED_WITH", "may_treat": "MAY_TREAT", "may_prevent": "MAY_PREVENT", "has_physiologic_effect": "HAS_PHYSIOLOGIC_EFFECT", "has_mechanism_of_action": "HAS_MECHANISM", "has_pharmacokinetics": "HAS_PHARMACOKINETICS", "induces": "INDUCES"}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def kind_of(semantic_types: Column, rest: str = "other") -> Column:
    """The kind of the first of an array of semantic types that has one."""
    table = {t: kind for kind, types in KINDS.items() for t in types.split()}
    return F.coalesce(F.get(F.filter(F.transform(semantic_types, lambda t: _looked_up(table, t)), lambda k: k.isNotNull()), F.lit(0)), F.lit(rest))


def edge_of(relation: Column) -> Column:
    """The edge that a relation makes; NULL for one that makes none."""
    return _looked_up(EDGES, relation)

"""Queries over file sources, Python functions and streams; SQL where a result can be stated so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlens.operators import cohort, probe, render
from counterlens.plans import samples
from counterlens.plans.oracle import with_base
from counterlens.plans.registry import Tables
from counterlens.sources import files
from counterlens.streaming import monitors


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir)["preds"]


def s01_jsonl(spark, d):
    path = files.scratch_path(spark, "jsonl")
    _events(spark, d).select("event_id", "event_type", "value").write.json(path)
    return files.read_jsonl(spark, path, "event_id long, event_type string, value double")


def s02_gz_csv(spark, d):
    path = files.scratch_path(spark, "csv")
    _events(spark, d).select("event_id", "event_type", "value").write.option("header", True).option("compression", "gzip").csv(path)
    return files.read_csv(spark, path, "event_id long, event_type string, value double")


def s16_split_sink(spark, d):
    path = files.scratch_path(spark, "splits")
    files.write_splits(Tables(spark, d)["items"].select("id", "label", "split"), path)
    return files.read_jsonl(spark, path, "id string, label string, split string")


def s17_merge_summary(spark, d):
    by = _preds(spark, d).groupBy("variant").agg(F.count_if("correct").alias("n")).withColumn("seed", F.lit(0).cast("long"))
    old = by.where("variant <> 'uq'").withColumn("n", F.lit(-1).cast("long"))
    return files.merge_summary(old, by.where("variant IN ('uq', 'rag')"), ["variant", "seed"])


def s23_keyed_files(spark, d):
    path = files.scratch_path(spark, "keyed")
    for k in ("a", "b"):
        _events(spark, d).where(F.col("event_id") % 2 == int(k == "b")).select("event_id").write.json(f"{path}/preds_{k}")
    return files.read_keyed(spark, f"{path}/preds_*", "event_id long", "preds_([a-z]+)")


def _folded(spark, d):
    p = _preds(spark, d)
    return p.select(F.concat_ws("/", "variant", "family").alias("stream"), F.col("item_no").alias("seq"), "u", (F.coalesce(F.col("own") == F.col("label"), F.lit(False))).alias("ok"))


def u13_adaptive(spark, d):
    return monitors.adaptive_batch(_folded(spark, d))


def st5_coverage_monitor(spark, d):
    return monitors.coverage_monitor(_preds(spark, d).select("ts", "label", "pred", "abstained")).withColumn("coverage", F.round("coverage", 9))


def x03_permutation(spark, d):
    p = _preds(spark, d).select("id", "variant", "pred")
    again = cohort.predictions(cohort.items(_events(spark, d).repartition(7, "value"))).select("id", "variant", "pred")
    return p.exceptAll(again).agg(F.count("*").alias("moved"))


def s10_cached_client(spark, d):
    cache = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("/b?id="), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("body"))
    return files.CachedClient(cache).lookup(cache.select("key"))


def _streamed(spark, d):
    path = files.scratch_path(spark, "events")
    _events(spark, d).select("event_id", "event_type").repartition(3).write.parquet(path)
    return monitors.file_stream(spark, path)


def st2_file_stream(spark, d):
    name = "counts_" + files.uuid.uuid4().hex
    run = _streamed(spark, d).groupBy("event_type").count().writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", files.scratch_path(spark, "state")).start()
    run.processAllAvailable()
    run.stop()
    return spark.table(name).select("event_type", F.col("count").alias("n"))


def st4_repeatable_sink(spark, d):
    path = files.scratch_path(spark, "sink")
    run = _streamed(spark, d).writeStream.foreachBatch(monitors.once_per_batch(path)).option("checkpointLocation", files.scratch_path(spark, "state")).start()
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(path).select("event_id", "event_type")


def s01_bad_lines(spark, d):
    """Lines that strict reading would stop at: every fifth line is broken, every seventh blank. Ids follow each other in a file, so an id less its line is one number a file."""
    path = files.scratch_path(spark, "bad-jsonl")
    n = F.col("event_id")
    line = F.when(n % 5 == 0, F.concat(F.lit('{"event_id": '), n.cast("string"))).when(n % 7 == 0, "").otherwise(F.to_json(F.struct("event_id")))
    _events(spark, d).repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    bad = files.bad_lines(spark, path, "event_id long").withColumn("off", F.regexp_extract("text", r"\d+$", 0).cast("long") - F.col("line"))
    return bad.join(bad.groupBy("file").agg(F.min("off").alias("first")), "file").select("text", (F.col("off") == F.col("first")).alias("placed"))


def s08_concat(spark, d):
    path = files.scratch_path(spark, "csv-parts")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    for k in (0, 1):
        docs.where(F.col("doc_id") % 2 == k).write.option("header", True).csv(f"{path}/part{k}")
    return files.read_csv(spark, [f"{path}/part0", f"{path}/part1"], "doc_id long, lang string, source string")


def s12_npz_source(spark, d):
    path = files.scratch_path(spark, "npz")
    made = files.write_arrays(spark.read.parquet(f"{d}/embeddings.parquet"), path, "vec_id", "embedding")
    made.write.parquet(f"{path}-names")
    names = [r["file"] for r in spark.read.parquet(f"{path}-names").collect()]
    rows = files.read_arrays(spark, names, ["ids", "w"])
    by = rows.groupBy("file", "row").agg(F.max(F.when(F.col("name") == "ids", F.col("x")[0])).cast("long").alias("vec_id"), F.max(F.when(F.col("name") == "w", F.col("x"))).alias("w"))
    return by.select("vec_id", F.size("w").cast("long").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def s13_artifact(spark, d):
    """The first artifact that exists of three names; an optional one that does not is none."""
    path = files.scratch_path(spark, "artifact")
    body = _preds(spark, d).groupBy().agg(F.count("*").alias("n"), F.count_if("abstained").alias("abstained")).select(F.to_json(F.struct("n", "abstained")))
    body.coalesce(1).write.text(path)
    if files.read_artifact(spark, [path + "-none"], required=False) is not None:
        raise AssertionError("an artifact that was never written")
    found = files.read_artifact(spark, [path + "-none", path + "-neither", path]).where("body <> ''")
    return found.select(F.get_json_object("body", "$.n").cast("long").alias("n"), F.get_json_object("body", "$.abstained").cast("long").alias("abstained"))


def s14_markdown_source(spark, d):
    """Tables of two sections of a document, one of them below prose."""
    path = files.scratch_path(spark, "report-md")
    p = _preds(spark, d)
    one, two = files.report(p.groupBy("variant").count().orderBy("variant")), files.report(p.groupBy("family", "label").count().orderBy("family", "label"))
    spark.createDataFrame([(f"# Variants\n\n{one}\n\nSome prose.\n\n## Families\nMore | prose\n\n{two}\n",)], "value string").coalesce(1).write.text(path)
    lines = spark.read.text(path, wholetext=True).select(F.lit("r").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    rows = files.markdown_tables(lines).where("cells[0] NOT IN ('variant', 'family')")
    return rows.select("section", F.concat_ws("/", F.slice("cells", 1, F.size("cells") - 1)).alias("name"), F.element_at("cells", -1).cast("long").alias("n"))


def s18_csv_sink(spark, d):
    path = files.scratch_path(spark, "report")
    files.write_csv(_preds(spark, d).groupBy("variant").agg(F.avg("u").alias("u"), F.count("*").alias("n")), path, {"u": 4})
    return files.read_csv(spark, path, "variant string, u string, n long")


def s19_array_sink(spark, d):
    path = files.scratch_path(spark, "arrays")
    made = files.write_arrays(spark.read.parquet(f"{d}/embeddings.parquet"), path, "vec_id", "embedding")
    return made.agg(F.sum("n").alias("n"))


def s20_report(spark, d):
    text = files.report(_preds(spark, d).groupBy("variant").agg(F.count("*").alias("n"), F.count_if("correct").alias("k")).orderBy("variant"))
    return spark.createDataFrame([(text,)], "text string").select(F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def p08_family_render(spark, d):
    families = spark.createDataFrame(samples.FAMILIES, "family string, explicit string, implicit string")
    i = Tables(spark, d)["items"]
    value = F.round("factor_value").cast("long").cast("string")
    made = render.render(i, families, value, F.col("sid") * 7 + F.col("rule_order"))
    return made.select("id", "vignette", "skeleton")


def f26_distractors(spark, d):
    i = Tables(spark, d)["items"].select("pair_id", "sid", "rule_order").distinct()
    return i.select("pair_id", render.distractors(F.col("sid") * 7 + F.col("rule_order")).alias("labs"))


def u20_probe(spark, d):
    """Neighbouring vectors as pairs, the first of each as the label; and a planted label that the vectors hold."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    pair, first = F.floor(F.col("vec_id") / 2).cast("string").alias("pair"), (F.col("vec_id") % 2).cast("int").alias("label")
    x = F.col("embedding").cast("array<double>")
    planted = F.transform(x, lambda v, i: F.when(i == 0, v + F.col("vec_id") % 2).otherwise(v))
    both = [probe.probe(e.select(pair, first, v.alias("x")), folds=3, components=8, permutations=60).withColumn("vectors", F.lit(n)) for v, n in ((x, "as they are"), (planted, "planted"))]
    return both[0].unionByName(both[1])


def st1_adaptive_stream(spark, d):
    """Rows arrive in four batches, in order; each is folded as it comes, and stored so that a repeated batch replaces itself."""
    path, out, state = (files.scratch_path(spark, n) for n in ("stream", "stream-out", "stream-state"))
    rows = _folded(spark, d)
    cuts = rows.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01)
    edges = [float("-inf"), *cuts, float("inf")]
    rows.limit(0).write.parquet(path)
    with monitors.state_store(spark):
        for a, b in zip(edges, edges[1:]):
            rows.where((F.col("seq") > a) & (F.col("seq") <= b)).write.mode("append").parquet(path)
            stream = monitors.adaptive_stream(spark.readStream.schema(rows.schema).parquet(path))
            run = stream.writeStream.foreachBatch(monitors.once_per_batch(out)).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.parquet(out).drop("batch")


QUERIES = {f.__name__: f for f in (s01_jsonl, s01_bad_lines, s08_concat, s12_npz_source, f26_distractors, s02_gz_csv, s10_cached_client, s13_artifact, s19_array_sink, s20_report, st2_file_stream, st4_repeatable_sink, s14_markdown_source, s16_split_sink, s17_merge_summary, s18_csv_sink, s23_keyed_files, u13_adaptive, u20_probe, st1_adaptive_stream, st5_coverage_monitor, p08_family_render, x03_permutation)}

_LABS = [f"'{t.split('{v}')[0]}' || ['" + "', '".join(v.split()) + f"'][D // {7 + i} % 5 + 1] || '{t.split('{v}')[1]}'" for i, (t, v) in enumerate(render.DISTRACTORS.items())]
_DRAWN = f"array_to_string(list_transform(range(0, 3), lambda k: [{', '.join(_LABS)}][(D % {len(_LABS)} + k) % {len(_LABS)} + 1]), ', ')".replace("D ", "(sid * 7 + rule_order) ")
_FORMS = " ".join(f"WHEN family = '{f}' THEN " + (f"CASE WHEN presentation = 'implicit' THEN '{i}' ELSE '{e}' END" if i else f"'{e}'") for f, e, i in samples.FAMILIES)

ORACLE_SQL = {
    name: with_base(sql)
    for name, sql in {
        "s01_jsonl": "SELECT event_id, event_type, value FROM events",
        "s13_artifact": "SELECT count(*) AS n, count(*) FILTER (WHERE abstained) AS abstained FROM preds",
        "s19_array_sink": "SELECT CAST(count(*) AS BIGINT) AS n FROM embeddings",
        "s20_report": "WITH r AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE correct) AS k FROM preds GROUP BY variant) SELECT 0::BIGINT AS line, '| variant | n | k |' AS text UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY variant), '| ' || variant || ' | ' || n || ' | ' || k || ' |' FROM r",
        "s14_markdown_source": "SELECT 'Variants' AS section, variant AS name, count(*) AS n FROM preds GROUP BY variant UNION ALL SELECT 'Families', family || '/' || label, count(*) FROM preds GROUP BY family, label",
        "s18_csv_sink": "SELECT variant, printf('%.4f', avg(u)) AS u, count(*) AS n FROM preds GROUP BY variant",
        "s01_bad_lines": "SELECT '{\"event_id\": ' || CAST(event_id AS VARCHAR) AS text, TRUE AS placed FROM events WHERE event_id % 5 = 0",
        "s08_concat": "SELECT doc_id, lang, source FROM documents",
        "s12_npz_source": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
        "f08_locate": "SELECT event_id, CASE WHEN value <> floor(value) THEN 6e0 END AS start, CASE WHEN value <> floor(value) THEN 6e0 + length(CAST(value AS VARCHAR)) END AS stop FROM labs",
        "st3_budget": "SELECT * FROM (SELECT lang AS stream, doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS running FROM documents) AS x WHERE running <= 20000",
        "f26_distractors": f"SELECT DISTINCT pair_id, {_DRAWN} AS labs FROM items",
        "p08_family_render": f"WITH x AS (SELECT id, CAST(CAST(round(factor_value) AS BIGINT) AS VARCHAR) AS v, CASE {_FORMS} END AS form, {_DRAWN} AS labs FROM items), y AS (SELECT id, v, CASE WHEN contains(form, 'The team proposes') THEN replace(form, 'The team proposes', 'Other results: ' || labs || '. The team proposes') ELSE form || ' Other results: ' || labs || '.' END AS s FROM x) SELECT id, replace(s, '{{value}}', v) AS vignette, replace(s, '{{value}}', '<FACTOR>') AS skeleton FROM y",
        "s02_gz_csv": "SELECT event_id, event_type, value FROM events",
        "s10_cached_client": "SELECT '/b?id=' || CAST(item_id AS VARCHAR) AS key, text AS body FROM benchmark",
        "st2_file_stream": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "st4_repeatable_sink": "SELECT event_id, event_type FROM events",
        "s16_split_sink": "SELECT id, label, split FROM items",
        "s17_merge_summary": "SELECT variant, CAST(0 AS BIGINT) AS seed, CASE WHEN variant IN ('uq', 'rag') THEN count(CASE WHEN correct THEN 1 END) ELSE -1 END AS n FROM preds GROUP BY variant",
        "s23_keyed_files": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS file_key FROM events",
        "st5_coverage_monitor": "SELECT date_trunc('day', ts) AS start, count(*) AS n, round(avg(CASE WHEN abstained THEN 0e0 ELSE 1e0 END), 9) AS coverage, count(CASE WHEN label = 'UNSAFE' AND pred = 'SAFE' AND NOT abstained THEN 1 END) AS violations FROM preds GROUP BY 1",
        "f11_rewrite": "SELECT event_id, 'Z 7 B' AS note FROM events WHERE value IS NOT NULL",
        "x03_permutation": "SELECT CAST(0 AS BIGINT) AS moved",
    }.items()
}

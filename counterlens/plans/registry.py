"""Named queries: plans written in SQL that Catalyst optimises, over the base tables.

A plan is a function of a dialect, which supplies the few functions whose names differ
between this engine and the one that checks results. Here plans run as Spark SQL over
views of the tables and of the DataFrames that ``operators.cohort`` derives.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from counterlens.operators import cohort
from counterlens.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    def text(self, s: str) -> str:
        return "r'" + s.replace("'", "\\'") + "'"

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.text(pattern)}, {group})"

    def extract_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.text(pattern)}, 0)"

    def matches(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {self.text(pattern)})"

    def replace_all(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, {self.text(pattern)}, '{to}')"

    def split(self, s: str, pattern: str) -> str:
        return f"split({s}, {self.text(pattern)})"

    def explode(self, array: str, table: str, column: str) -> str:
        return f", LATERAL explode({array}) AS {table}({column})"

    def length(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def item(self, array: str, i: str) -> str:
        return f"try_element_at({array}, CAST({i} AS INT))"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def map(self, array: str, v: str, body: str) -> str:
        return f"transform({array}, {v} -> {body})"

    def keep(self, array: str, v: str, body: str) -> str:
        return f"filter({array}, {v} -> {body})"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, '{sep}')"

    def stamp(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')"

    def parse_stamp(self, s: str) -> str:
        return f"to_timestamp({s}, 'yyyy-MM-dd HH:mm:ss')"

    def seconds(self, ts: str) -> str:
        return f"unix_timestamp({ts})"

    def sha(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def json(self, s: str, key: str) -> str:
        return f"get_json_object({s}, '$.{key}')"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def slice(self, array: str, n: str) -> str:
        return f"slice({array}, 1, {n})"


Plan = Callable[[object], str]
PLANS: dict[str, Plan] = {}


def _counts(sql: str) -> str:
    """count_if(x) as a count over a CASE, which is of one type in both engines."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def plan(name: str, body: Plan | str) -> None:
    """Register a plan: its text, or a function of the dialect."""
    PLANS[name] = lambda d: _counts(body(d) if callable(body) else body)


def rate(condition: str) -> str:
    """Share of rows for which the condition holds; NULL counts as not."""
    return f"avg(CASE WHEN {condition} THEN 1e0 ELSE 0e0 END)"


#: Folders of derived tables that this process has stored, by application, source folder and name.
_stored: dict[tuple[str, str, str], str] = {}
DERIVED = ("patients", "labs", "rules", "variants", "facts", "items", "preds")


def forget(spark: SparkSession) -> None:
    """Stored tables of this application are made anew when they are next asked for."""
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        del _stored[key]


class Tables:
    """Tables of a folder by name, and those derived from its events.

    Items and predictions are stored once a session and reread, as most queries begin
    with them; the others are cheap.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "rules":
            return cohort.rules(self.spark)
        if name == "variants":
            return cohort.variants(self.spark)
        if name in ("patients", "labs"):
            return getattr(cohort, name)(self["events"])
        if name == "facts":
            return cohort.facts(self["events"], self["rules"])
        if name == "items":
            return self._once(name, lambda: cohort.items(self["events"]))
        if name == "preds":
            return self._once(name, lambda: cohort.predictions(self["items"]))
        raise KeyError(name)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored or not files.exists(self.spark, _stored[key]):
            path = files.scratch_path(self.spark, name)
            make().write.parquet(path)
            _stored[key] = path
        return self.spark.read.parquet(_stored[key])


def in_session(spark: SparkSession, tables: Tables, sql: str) -> DataFrame:
    """The text over ``tables``; views have names of their own and go once the text is analysed."""
    used = [t for t in (*TABLES, *DERIVED) if re.search(rf"\b{t}\b", sql)]
    views = {t: f"_view_{uuid.uuid4().hex}" for t in used}
    try:
        for t, view in views.items():
            tables[t].createOrReplaceTempView(view)
        head = ", ".join(f"{t} AS (SELECT * FROM {view})" for t, view in views.items())
        sql = sql.strip()
        if head:
            sql = f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
        return spark.sql(sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return in_session(spark, Tables(spark, sf_dir), PLANS[name](Spark()))

    return query


CALLS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def call(made: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a function of tables as the query of its name; the plan of that name, if any, then only checks it."""
    CALLS[made.__name__] = lambda spark, sf_dir: made(Tables(spark, sf_dir))
    return made

"""The text of every plan for the checking engine."""

from __future__ import annotations

from counterlens.plans.base_sql import BASE
from counterlens.plans.registry import PLANS, Spark


class Duck(Spark):
    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.text(pattern)})"

    def replace_all(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, {self.text(pattern)}, '{to}', 'g')"

    def split(self, s: str, pattern: str) -> str:
        return f"regexp_split_to_array({s}, {self.text(pattern)})"

    def explode(self, array: str, table: str, column: str) -> str:
        return f", unnest({array}) AS {table}({column})"

    def length(self, array: str) -> str:
        return f"CAST(len({array}) AS BIGINT)"

    def item(self, array: str, i: str) -> str:
        return f"({array})[CAST({i} AS BIGINT)]"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def map(self, array: str, v: str, body: str) -> str:
        return f"list_transform({array}, lambda {v}: {body})"

    def keep(self, array: str, v: str, body: str) -> str:
        return f"list_filter({array}, lambda {v}: {body})"

    def join(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, '{sep}')"

    def stamp(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"

    def parse_stamp(self, s: str) -> str:
        return f"strptime({s}, '%Y-%m-%d %H:%M:%S')"

    def seconds(self, ts: str) -> str:
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def sha(self, s: str) -> str:
        return f"sha256({s})"

    def json(self, s: str, key: str) -> str:
        return f"json_extract_string({s}, '$.{key}')"

    def dot(self, a: str, b: str) -> str:
        return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def slice(self, array: str, n: str) -> str:
        return f"list_slice({array}, 1, {n})"


def with_base(sql: str) -> str:
    sql = sql.strip()
    return f"WITH {BASE}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {BASE} {sql}"


def oracle(name: str) -> str:
    return with_base(PLANS[name](Duck()))

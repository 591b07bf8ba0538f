"""Hard negatives: rows of another label that score nearly as high as an anchor's best of its own.

Components become floor(256 x), so a score is an integer inner product. An anchor's
positives are its ``positives`` best other rows of its label. Its hard negatives for a
positive are the ``negatives`` best rows of other labels that score between 50 % and 95 % of
the positive. Higher scores come first, ties by smaller id.

Method: candidates are dealt to shards and anchors to blocks, both of bounded bytes, by a
hash of the row, so no value is hot. Each pair of them is a task that builds a tree over its
candidates and one over its anchors. A node has a centre and a radius, so for two nodes all
inner products lie in an interval; an anchor node drops the candidate nodes whose interval
cannot reach what its anchors still want (for positives: as many scores as are wanted,
guaranteed by other nodes' lower ends; for negatives: the span of its anchors' windows), and
hands the rest down. Leaf pairs are pruned once more by anchor, as results come in, and
scored exactly. Spark merges the tasks' lists. The result is exact.

Cases: rows with a null id, label, vector, or any null or non-finite component take no part.
Zero vectors do. Vectors of different lengths are not compared. Equal rows count once; rows
that share an id are not each other's positives or negatives, and each is an anchor.
Copies of a vector are rows of their own, though a task compares only the first few by id. An
anchor without positives, or a positive without
negatives (all, where its score is below 0), has no rows. Scores that may pass 64 bits are an
error. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm.shared import Scratch

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 16 << 20
LEAST_SHARDS = 32
LEAF = 64
ANCHOR_LEAF = 32
STEP = 64
LOWEST = np.iinfo(np.int64).min


class Tree:
    """Balls over rows: a node's rows are ``order[begin:end]``; children of node i are ``left[i]`` and ``left[i] + 1``, -1 in a leaf."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        begin, end, left, centre, radius = [0], [len(x)], [-1], [], []
        i = 0
        while i < len(begin):
            rows = self.order[begin[i] : end[i]]
            part = x[rows]
            middle = part.mean(axis=0)
            centre.append(middle)
            radius.append(np.sqrt(((part - middle) ** 2).sum(axis=1).max()))
            if len(rows) > leaf and radius[i] > 0:
                values = part[:, part.var(axis=0).argmax()]
                half = len(rows) // 2
                self.order[begin[i] : end[i]] = rows[np.argpartition(values, half)]
                left[i] = len(begin)
                cut = begin[i] + half
                begin += [begin[i], cut]
                end += [cut, end[i]]
                left += [-1, -1]
            i += 1
        self.begin, self.end, self.left = np.array(begin), np.array(end), np.array(left)
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.length = np.sqrt((self.centre**2).sum(axis=1))
        self.n = self.end - self.begin

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[self.begin[i] : self.end[i]] for i in nodes])

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """Each node's children; leaves stay."""
        inner = nodes[self.left[nodes] >= 0]
        return np.concatenate((nodes[self.left[nodes] < 0], self.left[inner], self.left[inner] + 1))


def interval(a: Tree, node: int, b: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products of a row of ``a``'s node with a row of each node of ``b``."""
    middle = b.centre[nodes] @ a.centre[node]
    reach = a.radius[node] * b.length[nodes] + b.radius[nodes] * (a.length[node] + a.radius[node])
    # scores are whole numbers; a little room for what doubles lose
    room = 1e-6 + 1e-9 * (np.abs(middle) + reach)
    return np.ceil(middle - reach - room), np.floor(middle + reach + room)


class Wanted:
    """The best ``k`` results of each anchor in each of its windows of scores, as they come in."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), LOWEST)
        self.id = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to matter, by anchor and window."""
        return np.maximum(self.low[rows], self.score[rows, :, -1])

    def take(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, allowed) -> None:
        """Scores of these anchors (down) with these candidates (across); ``allowed`` tells which of some pairs may be results."""
        least, most = self.least(rows), self.high[rows]
        r, c = np.nonzero((score >= least.min(axis=1)[:, None]) & (score <= most.max(axis=1)[:, None]))
        fine = allowed(r, c)
        r, c = r[fine], c[fine]
        s, i = score[r, c].astype(np.int64), ids[c]
        for w in range(least.shape[1]):
            inside = np.flatnonzero((s >= least[r, w]) & (s <= most[r, w]))
            if len(inside):
                self._merge(rows, w, r[inside], s[inside], i[inside])

    def _merge(self, rows: np.ndarray, w: int, r: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        some, place = np.unique(r, return_inverse=True)
        held = rows[some]
        who = np.concatenate((np.repeat(np.arange(len(some)), self.k), place))
        s = np.concatenate((self.score[held, w].reshape(-1), s))
        i = np.concatenate((self.id[held, w].reshape(-1), i))
        order = np.lexsort((i, ~s, who))
        who, s, i = who[order], s[order], i[order]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        best = (first[:, None] + np.arange(self.k)).reshape(-1)
        self.score[held, w], self.id[held, w] = s[best].reshape(-1, self.k), i[best].reshape(-1, self.k)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held in doubles, of all rows of a with all rows of b: as doubles where those are exact."""
    longest = lambda x: float(np.sqrt((x * x).sum(axis=1)).max(initial=0))
    most = longest(a) * longest(b) * (1 + 1e-9)  # of the sum of the products' sizes as well
    if most < 1 << 53:
        return a @ b.T
    if most >= 1 << 63:
        raise OverflowError("inner products beyond 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def dual_search(anchors: Tree, a: np.ndarray, candidates: Tree, b: np.ndarray, ids: np.ndarray, wanted: Wanted, allowed, surely: int | None) -> int:
    """Fills ``wanted``; returns how many pairs were scored.

    ``allowed(rows, others)`` tells which of some pairs may be results. ``surely``: any so many
    candidates hold enough results for an anchor (None if that is not known).
    """
    norm = np.sqrt((a * a).sum(axis=1))
    scored = 0
    waiting = [(0, np.zeros(1, np.int64))]
    while waiting:
        node, nodes = waiting.pop()
        mine = anchors.order[anchors.begin[node] : anchors.end[node]]
        inside = anchors.left[node] < 0
        while True:
            low, high = interval(anchors, node, candidates, nodes)
            need = wanted.least(mine).min()
            if surely is not None:
                order = np.argsort(-low, kind="stable")
                enough = np.searchsorted(np.cumsum(candidates.n[nodes[order]]), surely)
                if enough < len(nodes):
                    need = max(need, low[order[enough]])
            nodes = nodes[(high >= need) & (low <= wanted.high[mine].max())]
            if not len(nodes):
                break
            further = candidates.below(nodes)
            if not inside:
                waiting += [(anchors.left[node] + 1, further), (anchors.left[node], further)]
                break
            if len(further) == len(nodes):
                scored += _leaf(mine, a, norm, candidates, nodes, b, ids, wanted, allowed)
                break
            nodes = further
    return scored


def _leaf(mine: np.ndarray, a: np.ndarray, norm: np.ndarray, candidates: Tree, nodes: np.ndarray, b: np.ndarray, ids: np.ndarray, wanted: Wanted, allowed) -> int:
    """An anchor leaf and the candidate leaves left for it, most promising first."""
    middle = a[mine] @ candidates.centre[nodes].T
    reach = norm[mine][:, None] * candidates.radius[nodes]
    reach += 1 + 1e-9 * (np.abs(middle) + reach)
    low, high = middle - reach, middle + reach
    scored, step = 0, 2
    while len(nodes):
        least, most = wanted.least(mine), wanted.high[mine]
        use = np.zeros(low.shape, bool)
        for w in range(least.shape[1]):
            use |= (high >= least[:, w, None]) & (low <= np.where(least[:, w] <= most[:, w], most[:, w], LOWEST)[:, None])
        promise = np.where(use, np.minimum(middle, most.max(axis=1)[:, None]), -np.inf).max(axis=0)
        left = np.flatnonzero(promise > -np.inf)
        order = left[np.argsort(-promise[left], kind="stable")]
        now, later = order[:step], order[step:]
        step = min(2 * step, STEP)
        if len(now):
            rows = candidates.rows(nodes[now])
            wanted.take(mine, products(a[mine], b[rows]), ids[rows], lambda r, c: allowed(mine[r], rows[c]))  # noqa: B023
            scored += len(mine) * len(rows)
        nodes, middle, low, high = nodes[later], middle[:, later], low[:, later], high[:, later]
    return scored


def _matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    values = table[column].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _thinned(table: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, label = _columns(table, "vec_id", "label")
    v = _matrix(table) + 0.0  # -0.0 equals 0.0
    some = thinned(ids, label, v, most)
    return ids[some], label[some], v[some]


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


def _listed(keys: np.ndarray, wanted: Wanted) -> dict[str, np.ndarray]:
    r, w, k = np.nonzero(wanted.score > LOWEST)
    return {"anchor": keys[r], "window": w, "vec_id": wanted.id[r, w, k], "score": wanted.score[r, w, k]}


def thinned(ids: np.ndarray, label: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest ids of each vector and label; no other copy can be among the first results."""
    rows = np.ascontiguousarray(np.column_stack((label, v.view(np.int64) if v.size else v)) if v.shape[1] else label[:, None])
    _, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).reshape(-1), return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    order = order[np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]))[: len(order)]]
    g = group[order]
    return np.sort(order[np.arange(len(g)) - np.searchsorted(g, g) < most])


FOUND = "anchor long, window int, vec_id long, score long"
_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _found(parts: list[dict[str, np.ndarray]]) -> pa.Table:
    return pa.concat_tables([pa.table({f.name: pa.array(p[f.name]).cast(f.type) for f in _FOUND}) for p in parts] or [_FOUND.empty_table()])


def _by_label(label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(label, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(rows):
            yield int(label[rows[0]]), rows


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Candidates of a shard (left) and anchors of a block (right): each anchor's best of its own label here."""
        if not left.num_rows or not right.num_rows:
            return _found([])
        (ids, label, b), (key, own, mine) = _thinned(left, k + 1), _columns(right, "anchor", "vec_id", "label")
        a, out = _matrix(right), []
        of_label = dict(_by_label(label))
        for each, rows in _by_label(mine):
            if each not in of_label:
                continue
            there = of_label[each]
            wanted = Wanted(np.full((len(rows), 1), LOWEST + 1), np.full((len(rows), 1), np.iinfo(np.int64).max), k)
            x, y, who, vec = a[rows], b[there], own[rows], ids[there]
            surely = k + int(np.unique(vec, return_counts=True)[1].max())  # an anchor's own rows do not count
            dual_search(Tree(x, ANCHOR_LEAF), x, Tree(y, LEAF), y, vec, wanted, lambda r, c: who[r] != vec[c], surely)
            out.append(_listed(key[rows], wanted))
        return _found(out)

    return run


def _negatives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each anchor's best of other labels here, within each of its windows."""
        if not left.num_rows or not right.num_rows:
            return _found([])
        (ids, label, b), (key, own, mine) = _thinned(left, k + 1), _columns(right, "anchor", "vec_id", "label")
        a = _matrix(right)
        wanted = Wanted(_matrix(right, "low"), _matrix(right, "high"), k)
        dual_search(Tree(a, ANCHOR_LEAF), a, Tree(b, LEAF), b, ids, wanted, lambda r, c: (mine[r] != label[c]) & (own[r] != ids[c]), None)
        return _found([_listed(key, wanted)])

    return run


def usable(vectors: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, label, v (whole numbers as doubles) and width of the rows that take part; ``label`` is an SQL expression."""
    known = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    scaled = lambda x: F.when(F.abs(x) * SCALE < 1 << 52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)  # noqa: E731  beyond that doubles are whole
    return rows.select("vec_id", "label", F.transform("x", scaled).alias("v"), F.size("x").alias("width"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: str, scratch: Scratch, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` is what ``usable`` makes; ``is_anchor`` is an SQL condition on its rows.
    """
    rows = scratch.table(vectors, "vectors")
    anchors = rows.where(is_anchor).distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "v"))
    anchors = scratch.table(anchors, "anchors")
    weigh = lambda df, name, each, least: df.groupBy("width").agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.greatest("width", F.lit(1)) * 8 / F.lit(each))).cast("int").alias(name))
    # there are no more widths than components in the longest vector
    parts = F.broadcast(scratch.table(weigh(rows, "shards", SHARD_BYTES, LEAST_SHARDS).join(weigh(anchors, "blocks", BLOCK_BYTES, 1), "width"), "parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["width", "shard", "block"]
    candidates = rows.join(parts, "width").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), "shards").cast("int")).withColumn("block", each("blocks")).drop("shards", "blocks")

    def searched(asking: DataFrame, search) -> DataFrame:
        block = F.pmod("anchor", "blocks").cast("int").alias("block")
        dealt = asking.join(parts, "width").select("*", block).withColumn("shard", each("shards")).drop("shards", "blocks")
        return candidates.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, FOUND)

    good = scratch.table(_best(searched(anchors, _positives(positives)), positives), "positives")
    # a positive's window of scores; those of an anchor side by side, in the order of their ranks
    ceil_, floor_ = F.expr(f"-((-score * {LEAST_PERCENT}) div 100)"), F.expr(f"(score * {MOST_PERCENT}) div 100")
    spans = good.where("score >= 0").select("anchor", "rank", ceil_.alias("low"), floor_.alias("high"))
    spans = spans.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("low", "high")))).alias("spans"))
    none = F.struct(F.lit(int(np.iinfo(np.int64).max)).alias("low"), F.lit(int(LOWEST)).alias("high"))
    placed = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(F.try_element_at("spans", k), none))
    asking = anchors.join(spans, "anchor").withColumn("spans", placed).withColumns({"low": F.col("spans.low"), "high": F.col("spans.high")}).drop("spans")
    bad = _best(searched(asking, _negatives(negatives)), negatives)

    chosen = good.select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.withColumn("window", F.col("window") + 1).join(chosen, ["anchor", "window"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(rows, "vec_id % 50 = 0", Scratch(spark, "negatives"))


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""

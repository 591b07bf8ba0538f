"""Nearest neighbours by inner product: one hierarchical navigable small-world graph a shard.

Rows are dealt to shards by a hash of their id and vector. A shard's graph has levels:
every node is on level 0, one in ``LEVEL_STEP`` (by a hash) on each next. Levels are built
from the top by insertion: a new node searches the graph built so far for its nearest
nodes, links to some of them that lie in different directions, and is linked back; a node
with too many links chooses among them again. Nodes of the level above are inserted first,
so each level begins with links that reach far. Neighbours are stored as flat arrays with a
fixed number of places. A search enters at all nodes of the top level and goes down with a
beam of ``BEAM``; on level 0 it keeps the best ``ef`` nodes seen, opening several of the
best unopened ones of all queries of a block at a time. Inner products are searched on
vectors brought to one length by a further component, so the graph is one of angles and
large vectors are not passed over. Each shard returns its best for every query, with the
product in double precision on the original vectors; results are merged by rank.

How wide a search must be depends on the vectors. So each shard, once built, answers
``TRIALS`` of its own vectors by search and by brute force and keeps the smallest ``ef`` of
a doubling series whose recall is at least ``AIM``. Where that would have it look at much
of the shard, it is scanned instead. Every row is indexed; the trials only set ``ef``.

Rows of one vector are one node of their shard's graph: copies would link to one another
only and become unreachable. Their ids stand beside the node, ascending, and are listed
after the search, as many as the result can hold.

Cases: a vector that is null, empty, zero, or holds a null or a component that is not
finite takes no part, nor does a row without an id. Vectors of different lengths have no
product: each length is searched by itself. Rows that share an id are separate
candidates, but none answers a query of its own id. With fewer than k candidates all are
returned. Ties go to the smaller id. An empty table gives an empty result. Columns other
than the id and the vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm import kernel as K
from counterlens.llm.shared import Scratch

#: Rows of a shard: as many as make about ``SHARDS`` of them, within these bounds.
SHARD_ROWS = (16_384, 131_072)
SHARDS = 512
#: Bytes of vectors in a shard, whatever their length: a shard is one value of a row.
SHARD_BYTES = 64 << 20
QUERY_ROWS = 16_384
LINKS = 32
LEVEL_STEP = 32
BEAM = 32
BUILD_EF = 96
INSERT = 512
OPEN = 8
TRIALS = 128
AIM = 0.97
TOP = 20


def _exact(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Each query's k best rows of x, best first."""
    k, out = min(k, len(x)), []
    for a in range(0, len(q), max(1, (1 << 24) // len(x))):
        s = q[a : a + max(1, (1 << 24) // len(x))] @ x.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1).astype(np.int32))
    return np.concatenate(out)


def _choose(x: np.ndarray, own: np.ndarray, cand: np.ndarray, limit: int) -> np.ndarray:
    """Of candidates (-1 for none) at most ``limit`` for each node: those nearer to it than to any chosen one, then the nearest others."""
    out = np.full((len(own), limit), -1, np.int32)
    for a in range(0, len(own), 256):
        c = cand[a : a + 256]
        v = x[c]
        near = np.einsum("ijd,id->ij", v, x[own[a : a + 256]])
        near[(c < 0) | (c == own[a : a + 256, None])] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")
        c, near, v = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        again = np.zeros(c.shape, bool)  # the same candidate twice: equal scores stand together
        again[:, 1:] = c[:, 1:] == c[:, :-1]
        real = np.isfinite(near) & ~again
        among = v @ v.transpose(0, 2, 1)
        kept, count = np.zeros(c.shape, bool), np.zeros(len(c), np.int32)
        for j in range(c.shape[1]):
            blocked = (kept & (among[:, j] > near[:, j, None])).any(axis=1)
            kept[:, j] = real[:, j] & ~blocked & (count < limit)
            count += kept[:, j]
        rank = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :limit]
        best = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(c, rank, 1), -1)
        out[a : a + 256, : best.shape[1]] = best
    return out


class Graph:
    """Flat arrays of one shard: unit vectors, and by level its nodes and their neighbours."""

    def __init__(self, x: np.ndarray, hashes: np.ndarray):
        self.x = x
        sets, step = [np.arange(len(x), dtype=np.int32)], LEVEL_STEP
        while step < 1 << 40 and len(sets[-1]) > LEVEL_STEP and (nodes := np.flatnonzero(hashes % K.U64(step) == 0).astype(np.int32)).size:
            sets.append(nodes)
            step *= LEVEL_STEP
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(s, np.zeros((0, 0), np.int32)) for s in sets]
        for depth in reversed(range(len(sets))):
            self._build(depth, hashes, sets[depth + 1] if depth + 1 < len(sets) else sets[depth][:0])

    def _build(self, depth: int, hashes: np.ndarray, above: np.ndarray) -> None:
        nodes, x = self.levels[depth][0], self.x
        width = LINKS if depth == 0 else LINKS // 2
        links = np.full((len(nodes), width), -1, np.int32)
        self.levels[depth] = (nodes, links)
        rest = np.setdiff1d(nodes, above)
        rest = rest[np.argsort(hashes[rest], kind="stable")]
        first = np.concatenate((above, rest[: max(0, INSERT - len(above))]))
        rest = rest[max(0, INSERT - len(above)) :]
        near = first[_exact(x[first], x[first], min(len(first), 2 * width + 1))]
        self._link(depth, first, near)
        for a in range(0, len(rest), INSERT):
            new = rest[a : a + INSERT]
            start = self._descend(x[new], depth) if depth + 1 < len(self.levels) else np.tile(first[: 2 * BEAM], (len(new), 1))
            found = self._beam(depth, x[new], start, BUILD_EF)
            self._link(depth, new, found[:, : 2 * width])

    def _link(self, depth: int, new: np.ndarray, cand: np.ndarray) -> None:
        """Links of new nodes to some of their candidates, and back."""
        nodes, links = self.levels[depth]
        half = links.shape[1] // 2
        out = _choose(self.x, new, cand, half)
        links[np.searchsorted(nodes, new), :half] = out
        src, dst = np.repeat(new, half), out.reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        score = np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((-score, dst))
        src, dst = src[order], dst[order]
        target, begin, count = np.unique(dst, return_index=True, return_counts=True)
        if not len(target):
            return
        place = np.arange(len(dst)) - np.repeat(begin, count)
        ok = place < links.shape[1]
        more = np.full((len(target), links.shape[1]), -1, np.int32)
        more[np.repeat(np.arange(len(target)), count)[ok], place[ok]] = src[ok]
        at = np.searchsorted(nodes, target)
        links[at] = _choose(self.x, target, np.concatenate((links[at], more), 1), links.shape[1])

    def _descend(self, q: np.ndarray, depth: int) -> np.ndarray:
        """Nodes of the level above ``depth`` at which each query enters it."""
        top = self.levels[-1][0]
        here = np.tile(top[: 4 * LEVEL_STEP], (len(q), 1))
        for level in range(len(self.levels) - 1, depth, -1):
            here = self._beam(level, q, here, max(BEAM, 1))[:, :BEAM]
        return here

    def _beam(self, depth: int, q: np.ndarray, start: np.ndarray, ef: int) -> np.ndarray:
        """The ef best nodes of a level that were seen for each query, best first; -1 in unused places."""
        nodes_of, links = self.levels[depth]
        m, n, ef = len(q), len(nodes_of), max(ef, start.shape[1])
        seen = np.zeros((m, n), bool)
        nodes, score, opened = np.full((m, ef), -1, np.int32), np.full((m, ef), -np.inf, np.float32), np.ones((m, ef), bool)
        nodes[:, : start.shape[1]] = np.where(start >= 0, np.searchsorted(nodes_of, start), -1)
        row, col = np.nonzero(nodes >= 0)
        seen[row, nodes[row, col]] = True
        score[row, col] = np.einsum("ij,ij->i", self.x[nodes_of[nodes[row, col]]], q[row])
        opened[row, col] = False
        active, open_ = np.arange(m), min(OPEN, ef)
        while len(active):
            s, o = score[active], opened[active]
            pick = np.argpartition(np.where(o, np.inf, -s), open_ - 1, axis=1)[:, :open_]
            usable = ~np.take_along_axis(o, pick, 1)
            live = usable.any(axis=1)
            active, pick, usable = active[live], pick[live], usable[live]
            if not len(active):
                break
            o = opened[active]
            np.put_along_axis(o, pick, True, 1)
            opened[active] = o
            next_ = np.where(usable[:, :, None], links[np.take_along_axis(nodes[active], pick, 1)], -1).reshape(len(active), -1)
            row = np.repeat(np.arange(len(active)), next_.shape[1])
            flat = next_.reshape(-1)
            fresh = np.flatnonzero(flat >= 0)
            flat, row = (np.searchsorted(nodes_of, flat[fresh]) if depth else flat[fresh]), row[fresh]
            new = np.flatnonzero(~seen[active[row], flat])
            key = np.unique(row[new].astype(np.int64) * n + flat[new])
            row, flat = np.divmod(key, n)
            seen[active[row], flat] = True
            got = np.einsum("ij,ij->i", self.x[nodes_of[flat]], q[active[row]])
            good = got > score[active].min(axis=1)[row]
            row, flat, got = row[good], flat[good], got[good]
            width = np.bincount(row, minlength=len(active))
            w = int(width.max()) if len(row) else 0
            if not w:
                continue
            place = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
            more_n, more_s = np.full((len(active), w), -1, np.int32), np.full((len(active), w), -np.inf, np.float32)
            more_n[row, place], more_s[row, place] = flat, got
            all_n = np.concatenate((nodes[active], more_n), 1)
            all_s = np.concatenate((score[active], more_s), 1)
            all_o = np.concatenate((opened[active], more_n < 0), 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            nodes[active], score[active], opened[active] = (np.take_along_axis(x, top, 1) for x in (all_n, all_s, all_o))
        best = np.take_along_axis(nodes, np.argsort(-score, axis=1, kind="stable"), 1)
        return np.where(best >= 0, nodes_of[best], -1)

    def search(self, q: np.ndarray, ef: int, keep: int) -> np.ndarray:
        """The ``keep`` best nodes of ef seen for each query, best first; -1 in unused places. A shard of no more than ef nodes is scanned."""
        if len(self.x) <= ef:
            return _exact(q, self.x, keep)
        start = self._descend(q, 0) if len(self.levels) > 1 else np.tile(self.levels[0][0][: 2 * BEAM], (len(q), 1))
        return self._beam(0, q, start, ef)[:, :keep]

    def tuned(self, q: np.ndarray, k: int) -> int:
        """The smallest ef of a doubling series that finds ``AIM`` of the exact k best of these queries; all nodes if half of them would be needed."""
        want, ef = _exact(q, self.x, k), 2 * max(k, BEAM)
        while 2 * ef < len(self.x):
            got = self.search(q, ef, k)
            if np.mean([len(np.intersect1d(a, b)) for a, b in zip(want, got)]) >= AIM * want.shape[1]:
                return ef
            ef *= 2
        return len(self.x)


def _widen(v: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors brought to one length: products with queries keep their order."""
    if query:
        return np.pad(v / np.linalg.norm(v, axis=1, keepdims=True), ((0, 0), (0, 1))).astype(np.float32)
    u = v / longest
    return np.concatenate((u, np.sqrt(np.maximum(0, 1 - (u * u).sum(axis=1, keepdims=True)))), 1).astype(np.float32)


GRAPH = "width int, shard int, ids binary, first binary, vectors binary, longest double, ef int, nodes array<binary>, links array<binary>"


def _matrix(table: pa.Table) -> np.ndarray:
    values = table["v"].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _distinct(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, in the order of their smallest ids; the ids by vector, ascending; where each vector's begin."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], np.ascontiguousarray(v[order] + 0.0)  # -0.0 equals 0.0
    _, at, group = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).reshape(-1), return_index=True, return_inverse=True)
    turn = np.argsort(at)
    place = np.empty(len(at), np.int64)
    place[turn] = np.arange(len(at))
    group = place[group.reshape(-1)]
    return v[at[turn]], ids[np.argsort(group, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(at)))))


def _build(k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v, ids, first = _distinct(table["vec_id"].to_numpy(), _matrix(table))
        longest = float(np.linalg.norm(v, axis=1).max())
        hashes = K.mix(ids[first[:-1]].view(K.U64) ^ K.U64(0x9E3779B97F4A7C15))
        graph = Graph(_widen(v, longest, False), hashes)
        trials = np.argsort(K.mix(hashes))[:TRIALS]
        # copies of a vector, and the query itself, take places of the k wanted; a few more nodes than k are asked for
        ef = graph.tuned(_widen(v[trials], 0, True), k + 1)
        cols = [[key[0].as_py()], [key[1].as_py()], [ids.tobytes()], [first.astype(np.int64).tobytes()], [v.tobytes()], [longest], [ef], [[n.tobytes() for n, _ in graph.levels]], [[x.tobytes() for _, x in graph.levels]]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["width", "shard", "ids", "first", "vectors", "longest", "ef", "nodes", "links"])

    return run


def _own_rows(ids: np.ndarray, first: np.ndarray, qid: np.ndarray, found: np.ndarray) -> np.ndarray:
    """How many rows of each found node have the query's own id."""
    node = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((node, ids))
    by_id, node = ids[order], node[order]
    new = np.flatnonzero(np.append(True, (by_id[1:] != by_id[:-1]) | (node[1:] != node[:-1])))
    by_id, node, rows = by_id[new], node[new], np.diff(np.append(new, len(ids)))
    out = np.zeros(found.shape, np.int64)
    at, end = np.searchsorted(by_id, qid), np.searchsorted(by_id, qid, "right")
    left = np.flatnonzero(at < end)
    while len(left):
        out[left] += np.where(found[left] == node[at[left], None], rows[at[left], None], 0)
        at[left] += 1
        left = left[at[left] < end[left]]
    return out


def _listed(ids: np.ndarray, first: np.ndarray, qid: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of each query's k best rows, from the nodes it found; ties go to smaller ids."""
    own = _own_rows(ids, first, qid, found)
    rows = np.where(found < 0, 0, first[found + 1] - first[found])
    # nodes that score below the one at which k rows are reached cannot matter
    order = np.argsort(-score, axis=1, kind="stable")
    sorted_ = np.take_along_axis(score, order, 1)
    reached = np.cumsum(np.take_along_axis(np.minimum(rows - own, k), order, 1), axis=1) >= k
    least = np.where(reached.any(axis=1), sorted_[np.arange(len(found)), reached.argmax(axis=1)], -np.inf)
    take = np.where(score >= least[:, None], np.minimum(rows, k + own), 0).reshape(-1)
    query = np.repeat(np.repeat(np.arange(len(found)), found.shape[1]), take)
    begin = np.repeat(first[found].reshape(-1), take)
    near, vec = np.repeat(score.reshape(-1), take), ids[begin + np.arange(len(begin)) - np.repeat(np.cumsum(take) - take, take)]
    other = vec != qid[query]
    query, near, vec = query[other], near[other], vec[other]
    order = np.lexsort((vec, -near, query))
    query, near, vec = query[order], near[order], vec[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], vec[best], near[best]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added in order."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for d in range(a.shape[-1]):
        out += a[..., d] * b[..., d]
    return out


def _ask(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One shard's graph (left, one row) and one block of queries (right)."""
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        row = {c: left[c][0] for c in left.column_names}
        ids, first = np.frombuffer(row["ids"].as_buffer(), np.int64), np.frombuffer(row["first"].as_buffer(), np.int64)
        v = np.frombuffer(row["vectors"].as_buffer(), "<f8").reshape(len(first) - 1, -1)
        graph, ef = Graph.__new__(Graph), row["ef"].as_py()
        graph.x = _widen(v, row["longest"].as_py(), False)
        graph.levels = [(np.frombuffer(n.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.int32).reshape(len(n.as_buffer()) // 4, -1)) for n, x in zip(row["nodes"], row["links"])]
        out, step = [], max(16, min(512, (1 << 26) // max(1, len(v))))
        for a in range(0, right.num_rows, step):
            part = right.slice(a, step)
            q, qid = _matrix(part), part["vec_id"].to_numpy()
            found = graph.search(_widen(q, 0, True), ef, max(4 * k, 2 * BEAM))
            near = products(v[found], q[:, None, :])
            near[found < 0] = -np.inf
            who, vec, score = _listed(ids, first, qid, found, near, k)
            out.append(pa.table([pa.array(qid[who]), pa.array(vec), pa.array(score)], schema=schema))
        return pa.concat_tables(out)

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))


def search(vectors: DataFrame, is_query: str, scratch: Scratch, k: int = TOP, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row that ``is_query`` selects.

    ``vectors`` has vec_id and v, as ``usable`` makes them. The work is queries times
    shards, each a search; larger tables have larger shards.
    """
    rows = scratch.table(vectors.withColumn("width", F.size("v")), "vectors")
    by = scratch.table(rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if(F.expr(is_query)).alias("q")), "widths")
    n_rows = by.agg(F.sum("n")).first()[0] or 0
    size = shard_rows or max(SHARD_ROWS[0], min(SHARD_ROWS[1], n_rows // SHARDS))
    # there are no more widths than components in the longest vector
    held = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("width")))))
    parts = F.broadcast(by.select("width", F.ceil(F.col("n") / held).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("q") / F.lit(QUERY_ROWS))).cast("int").alias("blocks")))
    known = rows.join(parts, "width")
    place = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = known.select("width", "vec_id", "v", place("shards").alias("shard"))
    graphs = scratch.table(dealt.groupBy("width", "shard").applyInArrow(_build(k), GRAPH), "graphs")
    left = graphs.join(parts, "width").withColumn("block", each("blocks")).drop("shards", "blocks")
    right = known.where(is_query).withColumn("block", place("blocks")).withColumn("shard", each("shards")).select("width", "shard", "block", "vec_id", "v")
    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_ask(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, "vec_id % 20 = 0", Scratch(spark, "neighbours"))

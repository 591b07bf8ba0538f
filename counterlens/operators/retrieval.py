"""Retrieval over TF-IDF vectors and over dense vectors, and how well it found what it should.

Text vectors: lower-cased tokens of two or more word characters, stop words out first,
then single tokens and pairs of neighbours; weight (1 + ln tf) * idf with idf = ln((1 + N)
/ (1 + df)) + 1, brought to length 1. Vectors are made in DataFrame operations, terms as
64-bit hashes. Queries and passages are then dealt in blocks of bounded size, and each pair
of blocks is a task that keeps the best of its passages for its queries; the lists of all
tasks are merged. Nothing is collected or broadcast.

Ties go to the passage with the larger id, as a reversed stable sort gives.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from counterlens.operators.metrics import rate
from counterlens.sources import files

TOKEN = r"[\p{L}\p{N}_]{2,}"
# Common English function words; a shorter list than those of some libraries.
STOP = (
    "a about above after again against all almost alone along already also although always am among an and another any anyone anything are around as at be became because been before being below between both but by can "
    "cannot could did do does doing done down due during each either else ever every few for from further get had has have having he hence her here hers herself him himself his how however i if in indeed into is it its itself "
    "just least less many may me meanwhile might mine more most much must my myself neither never no nor not nothing now of off often on once one only onto or other others our ours out over own per perhaps please rather same see "
    "several she should since so some such than that the their them then there these they this those through thus to together too toward under until up upon us very was we well were what when where whether which while who whom "
    "whose why will with within without would yet you your yours"
).split()
#: Entries of vectors (terms or components) in a block; a task holds two blocks.
BLOCK_ENTRIES = 2_000_000
#: Passages of a block are passed in steps of so many; a query that cannot gain from a step skips it.
STEP = 4_096
PRODUCTS = 4_000_000


def tokens(text: Column) -> Column:
    """Tokens of a text in order, stop words left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP))


def terms(words: Column) -> Column:
    """Tokens and pairs of neighbours."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def tfidf(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, idf, w: the vectors of a corpus, each of length 1; texts without terms have no row."""
    # tokens are a column of their own, so that they are found once
    words = corpus.select(F.col(key).alias("key"), tokens(F.col(text)).alias("_words"))
    counted = words.select("key", F.explode(terms(F.col("_words"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    n = corpus.agg(F.count("*").alias("texts"))
    idf = counted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.ln((F.lit(1.0) + F.col("texts")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    raw = counted.join(idf, "term").withColumn("raw", (F.lit(1.0) + F.ln(F.col("tf").cast("double"))) * F.col("idf"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "key").select("key", "term", "idf", (F.col("raw") / F.col("norm")).alias("w"))


def _in_cells(left: DataFrame, right: DataFrame, blocks: tuple[int, int], run, out: str) -> DataFrame:
    """``run`` on every pair of a block of left and a block of right rows (each with a column key), as Arrow tables."""
    place = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumns({"_i": place(blocks[0])}).withColumn("_j", each(blocks[1]))
    b = right.withColumns({"_j": place(blocks[1])}).withColumn("_i", each(blocks[0]))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(run, out)


def _blocks(df: DataFrame, entries: Column) -> int:
    total = df.agg(F.sum(entries)).first()[0] or 0
    return max(1, -(-int(total) // BLOCK_ENTRIES))


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and where each row's begin, with the end."""
    flat = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


class _Best:
    """The k best (score, passage) of each query so far; of equal scores the larger passage number."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(queries, -np.inf)

    def take(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        q, i, s = np.concatenate((self.query, query)), np.concatenate((self.item, item)), np.concatenate((self.score, score))
        order = np.lexsort((-i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.query, self.item, self.score = (x[rank < self.k] for x in (q, i, s))
        last = rank == self.k - 1
        self.least[q[last]] = s[last]


def _scored(k: int, schema: pa.Schema):
    """Sparse products of a block of queries (left) and one of passages (right): key, terms (sorted hashes), w."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("key")
        (q_term, q_at), (p_term, p_at) = _ragged(left["terms"]), _ragged(right["terms"])
        (q_w, _), (p_w, _) = _ragged(left["w"]), _ragged(right["w"])
        owner, best = np.repeat(np.arange(left.num_rows), np.diff(q_at)), _Best(left.num_rows, k)
        for a in reversed(range(0, right.num_rows, STEP)):
            b = min(a + STEP, right.num_rows)
            # passages without a common term score 0; of those only the last k can matter
            last = np.arange(max(a, b - k), b)
            lo, hi = p_at[a], p_at[b]
            order = np.argsort(p_term[lo:hi], kind="stable")
            term, w = p_term[lo:hi][order], p_w[lo:hi][order]
            item = np.repeat(np.arange(a, b), np.diff(p_at[a : b + 1]))[order]
            begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            names, end = term[begin], np.append(begin[1:], len(term))
            at = np.minimum(np.searchsorted(names, q_term), max(0, len(names) - 1))
            known = names[at] == q_term if len(names) else np.zeros(len(q_term), bool)
            most = np.maximum.reduceat(w, begin) if len(term) else np.zeros(0)
            # a query gains nothing where even the largest weight of each of its terms is not enough
            bound = np.bincount(owner[known], q_w[known] * most[at[known]], minlength=left.num_rows)
            known &= (bound + 1e-9 >= best.least)[owner]
            zero = np.flatnonzero(best.least <= 0)
            found = [(np.repeat(zero, len(last)), np.tile(last, len(zero)), np.zeros(len(zero) * len(last)))]
            who, where, weight = owner[known], at[known], q_w[known]
            n = end[where] - begin[where]
            cuts = np.searchsorted(np.cumsum(n), np.arange(PRODUCTS, int(n.sum()) + PRODUCTS, PRODUCTS), "right")
            cuts = np.unique(np.concatenate(([0], np.searchsorted(who, who[np.minimum(cuts, len(who) - 1)]), [len(who)]))) if len(who) else [0]
            for c, d in zip(cuts, cuts[1:]):  # whole queries, some millions of products at a time
                m = n[c:d]
                post = np.arange(int(m.sum())) + np.repeat(begin[where[c:d]] - (np.cumsum(m) - m), m)
                cell, place = np.unique(np.repeat(who[c:d], m) * (b - a) + item[post] - a, return_inverse=True)
                s = np.bincount(place, np.repeat(weight[c:d], m) * w[post], minlength=len(cell)).round(12)
                found.append((cell // (b - a), cell % (b - a) + a, s))
            q, i, s = (np.concatenate(x) for x in zip(*found))
            # a pair that has a score is not also one without
            order = np.lexsort((-s, i, q))
            q, i, s = q[order], i[order], s[order]
            first = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))
            best.take(q[first], i[first], s[first])
        return pa.table([left["key"].take(pa.array(best.query)), right["key"].take(pa.array(best.item)), pa.array(best.score)], schema=schema)

    return run


def _packed(weights: DataFrame) -> DataFrame:
    """key, terms and w as arrays in the order of terms, one row a key."""
    by = weights.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("v"))
    return by.select("key", F.col("v.term").alias("terms"), F.col("v.w").alias("w"))


def _asked(queries: DataFrame, key: str, text: str, idf: DataFrame) -> DataFrame:
    """key, terms, w of every query; terms that the corpus lacks do not count, and a query without any has none."""
    keyed = queries.select(F.col(key).alias("key"), tokens(F.col(text)).alias("_words"))
    hashed = F.explode(F.transform(terms(F.col("_words")), lambda x: F.xxhash64(x))).alias("term")
    # terms that the corpus lacks go before anything is grouped
    tf = keyed.select("key", hashed).join(idf, "term").groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
    raw = tf.select("key", "term", ((F.lit(1.0) + F.ln(F.col("tf").cast("double"))) * F.col("idf")).alias("raw"))
    by = raw.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "raw"))).alias("v"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    vectors = by.select("key", F.col("v.term").alias("terms"), F.transform("v.raw", lambda x: x / F.col("norm")).alias("w"))
    return keyed.select("key").join(vectors, "key", "left")


def top_passages(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str, k: int = 3, text: str = "text") -> DataFrame:
    """query_key, rank, corpus_key, score: the k passages nearest by cosine; passages without a common term score 0.

    Keys should be unique. Work is the products of terms that a query and a passage share,
    less those of queries that cannot gain; every query block meets every passage block.
    """
    stored = files.scratch_path(queries.sparkSession, "passages")
    whole = tfidf(corpus, corpus_key, text).withColumn("term", F.xxhash64("term"))
    whole.write.parquet(f"{stored}/weights")
    weights = queries.sparkSession.read.parquet(f"{stored}/weights")
    idf = weights.groupBy("term").agg(F.max("idf").alias("idf"))
    passages = corpus.select(F.col(corpus_key).alias("key")).join(_packed(weights.select("key", "term", "w")), "key", "left")
    for name, df in (("passages", passages), ("queries", _asked(queries, query_key, text, idf))):
        df.write.parquet(f"{stored}/{name}")
    sides = [queries.sparkSession.read.parquet(f"{stored}/{n}") for n in ("queries", "passages")]
    size = 1 + F.coalesce(F.size("terms"), F.lit(0))
    out = sides[0].select(F.col("key").alias(query_key)).schema.add(sides[1].select(F.col("key").alias(corpus_key)).schema[0]).add("score", "double")
    found = _in_cells(*sides, tuple(_blocks(x, size) for x in sides), _scored(k, to_arrow_schema(out)), out)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.desc(corpus_key)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, "rank", corpus_key, "score")


def hits(ranked: DataFrame, query_key: str, passage: str, truth: DataFrame, gold: str, keys: Sequence[str], distractor: str, k: int = 3) -> DataFrame:
    """How retrieval did, by ``keys`` of ``truth`` (query_key, gold, ok, keys).

    hit at 1 to k, mean rank of the gold passage where found, precision at k (there is one
    gold passage), share of passages whose name begins with ``distractor`` among what was
    retrieved, and the share of right answers over all, with and without the gold passage.
    """
    row = ranked.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", passage))).alias("_got"))
    joined = truth.join(row, query_key, "left").withColumn("_names", F.transform(F.coalesce("_got", F.array().cast(row.schema["_got"].dataType)), lambda x: x[passage]))
    place = F.nullif(F.array_position("_names", F.col(gold)), F.lit(0).cast("long"))
    wrong = F.size(F.filter("_names", lambda x: x.startswith(distractor)))
    x = joined.withColumns({"_place": place, "_wrong": wrong, "_slots": F.size("_names")})
    found, ok = F.col("_place").isNotNull(), F.when(F.col("ok"), 1.0).otherwise(0.0)
    return x.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[rate(F.col("_place") <= i).alias(f"hit{i}") for i in range(1, k + 1)],
        F.avg(F.col("_place").cast("double")).alias("mean_rank"),
        (rate(F.col("_place") <= k) / k).alias("precision_at_k"),
        F.try_divide(F.sum("_wrong").cast("double"), F.sum("_slots").cast("double")).alias("distractor_share"),
        F.avg(ok).alias("accuracy"),
        F.avg(F.when(found, ok)).alias("accuracy_hit"),
        F.avg(F.when(~found, ok)).alias("accuracy_miss"),
    )


def _dense(k: int, absolute: bool, unit: bool):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("sim", pa.float64())])

    def matrix(table: pa.Table) -> np.ndarray:
        v = _ragged(table["v"])[0].reshape(table.num_rows, -1)
        return v / np.linalg.norm(v, axis=1, keepdims=True) if unit else v

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("key")
        q, v, best = matrix(left), matrix(right), _Best(left.num_rows, k)
        step = max(1, PRODUCTS // left.num_rows)
        for a in range(0, len(v), step):
            s = q @ v[a : a + step].T
            s = (np.abs(s) if absolute else s).round(6)
            # whatever is as good as the k best of the step
            least = np.maximum(best.least, np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else -np.inf)
            who, what = np.nonzero(s >= least[:, None])
            best.take(who, what + a, s[who, what])
        return pa.table([left["key"].take(pa.array(best.query)), right["key"].take(pa.array(best.item)), pa.array(best.score)], schema=schema)

    return run


def nearest(queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int, absolute: bool = False, unit: bool = False) -> DataFrame:
    """query_id, id, sim: each query's k candidates of largest product (of absolute value; of unit vectors), exactly.

    A stated set of queries against all candidates, both in blocks of bounded size: a task
    multiplies two blocks and keeps the best k of each query. The work is queries times
    candidates; for large sets use an index. Products are compared at six decimals; ties
    go to the larger id. All vectors have one length.
    """
    of = lambda df: df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
    sides = of(queries), of(candidates)
    found = _in_cells(*sides, tuple(_blocks(x, F.size("v")) for x in sides), _dense(k, absolute, unit), "query_id long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), F.desc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are runs of one to three characters of the lower-cased text, hashed to
2**``BITS`` bins. Counts by language give log probabilities with additive smoothing; the
matrix (bins x languages) is broadcast, and batches are scored sparsely in numpy over the
whole text.

Training takes labelled rows that are not held out, at most about ``SAMPLE`` a language,
chosen by a hash of the id at a rate that is SAMPLE over the language's row count. The
rates and priors come from counts over all rows. Languages are taken in groups of
``LANG_GROUP``: each group's matrix is made and broadcast by itself and passes the texts
once, so what the driver and a task hold of a model does not grow with the languages, and
any number of them is read. What a document's passes found is merged as they come.

Cases: null text and texts without a letter are ``und`` with score 0; so is every text if
nothing was learned. A null label is not learned from. A null id counts as the empty
string for the fold. Ties go to the language that comes first by code point. An empty
table gives an empty result. Predictions use the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from counterlens.llm import kernel as K

BITS = 16
SAMPLE = 4_000
LANG_GROUP = 128
ORDERS = 3
SMOOTHING = 0.5
UNKNOWN = "und"
RATE_STEPS = 1 << 30
CHUNK = 1 << 18
LANG_BLOCK = 8
FLUSH = 2_000_000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all n-grams, a document after another, and each document's offset."""
    joined = "\0".join(texts).lower() + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    n = len(points)
    wide = points.astype(K.U64)
    values = np.zeros((n, ORDERS), np.int32)
    real = np.zeros((n, ORDERS), bool)
    key, ok = np.zeros(n, K.U64), np.ones(n, bool)
    for k in range(ORDERS):
        key[: n - k] += wide[k:] * K.stream(60 + k, 1)[0]
        ok[: n - k] &= points[k:] != 0
        ok[n - k :] = False
        values[:, k] = ((key * K.stream(70 + k, 1)[0]) >> K.U64(64 - BITS)).astype(np.int32)
        real[:, k] = ok
    flat = real.reshape(-1)
    upto = np.concatenate(([0], np.cumsum(flat)))
    return values.reshape(-1)[flat], upto[np.concatenate(([0], ends)) * ORDERS]


def _texts(part: pa.RecordBatch) -> list[str]:
    # a zero character would end a document early
    return [(t or "").replace("\0", " ") for t in part.column("text").to_pylist()]


def _count(langs: list[str]):
    schema = pa.schema([("lang", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(langs)}
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            cells, first = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(first, np.concatenate([n for _, n in held]), minlength=len(cells)).astype(np.int64)
            return pa.record_batch([pa.array(cells >> BITS, pa.int32()), pa.array(cells & ((1 << BITS) - 1), pa.int32()), pa.array(n)], schema=schema)

        for part in K.chunks(batches, "text", CHUNK):
            bins, offs = features(_texts(part))
            lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
            held.append(np.unique(np.repeat(lang << BITS, np.diff(offs)) + bins, return_counts=True))
            size += len(held[-1][0])
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def rates(labelled: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int, int]]:
    """(lang, rows, rate) of every language, by code point; a row is learned from if its draw is below the rate."""
    counts = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect())
    return [(x, n, min(RATE_STEPS, -(-sample * RATE_STEPS // n))) for x, n in counts]


def train(labelled: DataFrame, group: list[tuple[str, int, int]], total: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A group's languages, log priors and log probabilities (bins x languages) from (doc_id, text, lang); ``total`` rows have a label."""
    langs = [x for x, *_ in group]
    small = labelled.sparkSession.createDataFrame([(x, rate) for x, _, rate in group], "lang string, rate long")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(RATE_STEPS))
    chosen = labelled.join(F.broadcast(small), "lang").where(draw < F.col("rate")).select("text", "lang")
    table = chosen.mapInArrow(_count(langs), "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    seen = np.full((1 << BITS, len(langs)), SMOOTHING)
    seen[table["bin"].to_numpy(), table["lang"].to_numpy()] += table["n"].to_numpy()
    seen /= seen.sum(axis=0)
    return langs, np.log(np.array([n for _, n, _ in group]) / total), np.log(seen, out=seen)


def score(bins: np.ndarray, offs: np.ndarray, prior: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log joint probability of each document with each language."""
    out = np.tile(prior, (len(offs) - 1, 1))
    filled = np.flatnonzero(np.diff(offs))
    if len(filled):
        for a in range(0, logs.shape[1], LANG_BLOCK):
            block = np.ascontiguousarray(logs[:, a : a + LANG_BLOCK])
            out[filled, a : a + LANG_BLOCK] += np.add.reduceat(block[bins], offs[filled], axis=0)
    return out


def _predict(model, schema: pa.Schema):
    """Task side: the best language, its joint probability and the sum of all, of one group and of the groups before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logs = model.value
        names = np.array(langs, object)
        for part in K.chunks(batches, "text", CHUNK):
            bins, offs = features(_texts(part))
            joint = score(bins, offs, prior, logs)
            best = joint.argmax(axis=1)
            most = joint[np.arange(len(best)), best]
            every = most + np.log(np.exp(joint - most[:, None]).sum(axis=1))
            before, upto = (part.column(c).to_numpy() for c in ("__joint", "__all"))
            wins = most > before  # of equals the group that comes first
            pred = np.where(wins, names[best], np.array(part.column("lang_pred").to_pylist(), object))
            made = {"lang_pred": pa.array(pred.tolist(), pa.string()), "__joint": pa.array(np.where(wins, most, before)), "__all": pa.array(np.logaddexp(every, upto))}
            yield pa.record_batch([made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def identify(docs: DataFrame, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score (the prediction's posterior), has_letter.

    ``keep`` names columns of ``docs`` to pass on.
    """
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")
    letter = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}").alias("has_letter")
    labelled = docs.select("doc_id", "text", "lang").where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = rates(labelled, sample)
    total = sum(n for _, n, _ in known)
    passed = [F.col(c) for c in keep or [] if c not in ("doc_id", "text", "held_out", "lang_pred", "score", "has_letter")]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held, letter, *passed)
    lowest = F.lit(float("-inf"))
    out = out.withColumns({"lang_pred": F.lit(None).cast("string"), "__joint": lowest, "__all": lowest})
    for a in range(0, len(known), LANG_GROUP):
        model = spark.sparkContext.broadcast(train(labelled, known[a : a + LANG_GROUP], total))
        out = out.mapInArrow(_predict(model, to_arrow_schema(out.schema)), out.schema)
    read = F.col("has_letter") & F.col("lang_pred").isNotNull()
    share = F.when(read, F.exp(F.col("__joint") - F.col("__all"))).otherwise(0.0)
    columns = ["doc_id", *[c for c in ["text"] if c in (keep or [])], *passed, "held_out", "has_letter"]
    return out.select(*columns, F.when(read, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), share.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("has_letter")

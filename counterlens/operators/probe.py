"""A linear probe of vectors, cross-validated by pairs, with a null of many permutations that keep the pairs' structure.

Labels trade places only inside pairs, so every pair keeps one of each and a constant answer
stays at no consistent pair. All folds and all permutations are fitted together: one pass
gives the sums that scale the vectors and find their components in every fold, and each
step of the fits is one pass that adds the gradients of all labellings at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.operators import sampling
from counterlens.sources import files

#: Partial sums meet in two steps; the first is by so many groups a fold.
GROUPS = 32
CHUNK = 4_096


def swapped(label: Column, pair: Column) -> Column:
    """A 0/1 label that trades places with the other of its pair where a coin of the pair says so."""
    return F.when(sampling.text_draw(pair.cast("string")) % 2 == 0, 1 - label).otherwise(label)


def coins(pairs: list[str], permutations: int, seed: int) -> np.ndarray:
    """0 or 1 by pair and permutation; column 0, the labels as they are, is 0."""
    raw = [np.frombuffer(b"".join(blake2b(f"{seed}|{i}|{p}".encode()).digest() for i in range(permutations // 512 + 1)), np.uint8) for p in pairs]
    drawn = np.unpackbits(np.array(raw, np.uint8).reshape(len(pairs), -1), axis=1)[:, :permutations]
    return np.column_stack((np.zeros(len(pairs), np.uint8), drawn))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    return x, batch.column("fold").to_numpy(), batch.column("label").to_numpy().astype(np.int64), batch.column("pair").to_pylist()


_SUMS = pa.schema([("fold", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])


def _summed(make):
    """Task side of a pass: one row a fold of the sums that ``make`` gives, over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                x, fold, label, pair = _arrays(batch.slice(a, CHUNK))
                for f in np.unique(fold):
                    of = fold == f
                    made = make(int(f), x[of], label[of], [p for p, o in zip(pair, of) if o])
                    for k, v in made.items():
                        total[k] = total[k] + v if k in total else v
        rows = [(k, int.from_bytes(blake2b(v.tobytes(), digest_size=4).digest(), "little") % GROUPS, v.tobytes()) for k, v in total.items()]
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _SUMS)], schema=_SUMS)

    return run


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_SUMS)


def _pass(rows: DataFrame, make) -> dict[int, np.ndarray]:
    """Sums by fold, of a size that the dimension and the number of labellings settle."""
    ddl = "fold int, part int, sums binary"
    parts = rows.mapInArrow(_summed(make), ddl).groupBy("fold", "part").applyInArrow(_add, ddl)
    return {r.fold: np.frombuffer(r.sums) for r in parts.groupBy("fold").applyInArrow(_add, ddl).collect()}


def _basis(n: float, mean: np.ndarray, second: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the scaled vectors' principal components lie: x becomes (x - centre) @ basis."""
    cov = second / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    keep = np.argsort(-values)[: min(components, len(sd), max(1, int(n) - 1))]
    return mean, vectors[:, keep] / sd[:, None]


def probe(rows: DataFrame, folds: int = 5, components: int = 128, c: float = 0.05, permutations: int = 200, seed: int = 0, steps: int = 200, tolerance: float = 1e-7) -> DataFrame:
    """One row: n, pairs, accuracy, consistency (pairs with all arms right), the null's means, and p values.

    ``rows`` has pair, x (array) and label (0 or 1). Pairs stay in one fold. Scaling and
    components are those of the training folds only; the fit is a logistic one with an
    intercept and a penalty of ||w||^2 / (2 c). Fits go in steps that a bound of the second
    derivative, shared by all labellings, keeps from overshooting, until no weight moves by
    ``tolerance`` or for ``steps``. A p value is (1 + permutations at least as good) /
    (1 + permutations). An answer on the border is label 0. Without rows it is an error.
    """
    spark = rows.sparkSession
    path = files.scratch_path(spark, "probe")
    placed = rows.join(sampling.grouped_folds(rows, "pair", folds), "pair")
    # both arms of a pair lie in one task, side by side
    placed.select(F.col("pair").cast("string").alias("pair"), F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x")).repartition("pair").sortWithinPartitions("pair").write.parquet(path)
    rows = spark.read.parquet(path)

    moments = _pass(rows, lambda f, x, y, p: {f: np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))})
    if not moments:
        raise ValueError("nothing to probe")
    d = int(round((-1 + np.sqrt(1 + 4 * (len(next(iter(moments.values()))) - 1))) / 2))
    every = sum(moments.values())
    bases, train = {}, {}
    for f in moments:
        s = every - moments[f] if len(moments) > 1 else every
        bases[f], train[f] = _basis(s[0], s[1 : d + 1] / s[0], s[d + 1 :].reshape(d, d), components), s[0]

    def inputs(f: int, x: np.ndarray) -> np.ndarray:
        centre, basis = bases[f]
        return np.column_stack((np.ones(len(x)), (x - centre) @ basis))

    others = lambda g: [f for f in bases if f != g or len(bases) == 1]  # noqa: E731  folds that train on the rows of fold g
    grams = _pass(rows, lambda g, x, y, p: {f: (lambda z: (z.T @ z).ravel())(inputs(f, x)) for f in others(g)})
    m = permutations + 1
    inverse, w = {}, {}
    for f, gram in grams.items():
        k = int(round(np.sqrt(len(gram))))
        penalty = np.diag([0.0] + [1 / c] * (k - 1))
        inverse[f] = (np.linalg.inv(gram.reshape(k, k) / 4 + penalty + 1e-9 * np.eye(k)), penalty)
        w[f] = np.zeros((k, m))
    for _ in range(steps):
        held = spark.sparkContext.broadcast(w)

        def gradient(g, x, y, p, held=held):
            labels = y[:, None] ^ coins(p, permutations, seed)
            out = {}
            for f in others(g):
                z = inputs(f, x)
                out[f] = (z.T @ (1 / (1 + np.exp(-(z @ held.value[f]))) - labels)).ravel()
            return out

        moved = 0.0
        for f, grad in _pass(rows, gradient).items():
            step = inverse[f][0] @ (grad.reshape(w[f].shape) + inverse[f][1] @ w[f])
            w[f] = w[f] - step
            moved = max(moved, float(np.abs(step).max()))
        held.unpersist()
        if moved < tolerance:
            break
    final = spark.sparkContext.broadcast(w)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, all_right = np.zeros(2 * m + 2), None, None
        for batch in batches:
            x, fold, label, pair = _arrays(batch)
            for a in range(0, len(x), CHUNK):
                part = slice(a, a + CHUNK)
                ok = np.zeros((len(x[part]), m), bool)
                for g in np.unique(fold[part]):
                    of = fold[part] == g
                    said = inputs(int(g), x[part][of]) @ final.value[int(g)] > 0
                    ok[of] = said == (label[part][of][:, None] ^ coins([p for p, o in zip(pair[part], of) if o], permutations, seed)).astype(bool)
                total[0] += len(ok)
                total[2 : 2 + m] += ok.sum(0)
                for p, row in zip(pair[part], ok):
                    if p != last:
                        if all_right is not None:
                            total[1] += 1
                            total[2 + m :] += all_right
                        last, all_right = p, row.copy()
                    else:
                        all_right &= row
        if all_right is not None:
            total[1] += 1
            total[2 + m :] += all_right
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_SUMS)

    total = sum(np.frombuffer(r.sums) for r in rows.mapInArrow(judged, "fold int, part int, sums binary").groupBy("fold").applyInArrow(_add, "fold int, part int, sums binary").collect())
    n, pairs = int(total[0]), int(total[1])
    accuracy, consistency = total[2 : 2 + m] / n, total[2 + m :] / pairs
    p = lambda v: float((1 + (v[1:] >= v[0] - 1e-12).sum()) / m)
    null = lambda v: float(v[1:].mean()) if permutations else None
    row = (n, pairs, float(accuracy[0]), float(consistency[0]), null(accuracy), null(consistency), p(accuracy), p(consistency), permutations)
    return spark.createDataFrame([row], "n long, pairs long, accuracy double, consistency double, null_accuracy double, null_consistency double, p_accuracy double, p_consistency double, permutations int")

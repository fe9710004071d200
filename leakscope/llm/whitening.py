"""Whitening of embeddings by an exact bit-sliced scatter.

Vectors become integers. A task shifts each dimension to start at zero, packs the
bits of one weight of a dimension across rows into words, and adds up the set bits
of the AND of every two such planes, weighted by their powers of two. That gives the
cross-products of all rows as whole numbers, in any order of tasks, so the
covariance is centred without rounding before its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import once

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows whose planes are packed at once.
SLICE_ROWS = 16_384
#: Entries beyond are taken as this, so that a long holds them.
LARGEST = 2**62
_LIMB, _LIMBS = 32, 6


class Model(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float
    reach: int  # no square of n * x - S is larger


def as_integers(column: pa.ListArray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose vector is whole and finite, and their entries as integers."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    rows = np.nonzero(lengths == dimensions)[0]
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    entries = flat.reshape(len(rows), dimensions)
    whole = np.isfinite(entries).all(axis=1)
    with np.errstate(over="ignore"):
        floors = np.clip(np.floor(SCALE * entries[whole]), -LARGEST, LARGEST)
    return rows[whole], floors.astype(np.int64) + SHIFT


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every plane, its dimension and its power; ``shifted`` has a row per dimension."""
    planes, owners, powers = [], [], []
    words = -(-shifted.shape[1] // 64)
    for k, entries in enumerate(shifted):
        for power in range(int(entries.max(initial=0)).bit_length()):
            bits = np.packbits(((entries >> np.uint64(power)) & np.uint64(1)).astype(np.uint8))
            packed = np.zeros(8 * words, dtype=np.uint8)
            packed[: len(bits)] = bits
            planes.append(packed.view(np.uint64))
            owners.append(k)
            powers.append(power)
    return np.array(planes, dtype=np.uint64).reshape(-1, words), np.array(owners, np.int64), np.array(powers, np.int64)


def sliced_products(shifted: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of every two dimensions, as Python numbers."""
    planes, owners, powers = bit_planes(shifted)
    size = len(shifted)
    total = np.zeros((size, size), dtype=object)
    if not len(planes):
        return total
    # With few bits a dimension's weighted counts fit into a long.
    narrow = 2 * int(powers.max()) + shifted.shape[1].bit_length() + int(powers.max()).bit_length() <= 60
    weights = 1 << powers if narrow else np.array([1 << int(p) for p in powers], dtype=object)
    for i in range(len(planes)):
        counts = np.bitwise_count(planes[i:] & planes[i]).sum(axis=1, dtype=np.int64)
        counts[1:][owners[i + 1 :] == owners[i]] *= 2  # both orders of a dimension's own planes
        weighted = counts * weights[i:] if narrow else counts.astype(object) * weights[i:]
        starts = np.nonzero(np.diff(owners[i:], prepend=-1))[0]
        sums = np.add.reduceat(weighted, starts)
        total[owners[i], owners[i:][starts]] += sums.astype(object) * (1 << int(powers[i]))
    return total + np.triu(total, 1).T


def _scatter(dimensions: int):
    """Limbs of the sums over this task of all products of entries, entries and ones.

    A last dimension holds ones, so its products are the sums and the count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1), dtype=object)
        for batch in batches:
            _, entries = as_integers(batch.column("embedding"), dimensions)
            for at in range(0, len(entries), SLICE_ROWS):
                part = np.ascontiguousarray(entries[at : at + SLICE_ROWS].T)
                least = part.min(axis=1)
                shifted = part.view(np.uint64) - least.view(np.uint64)[:, None]
                ones = np.ones((1, shifted.shape[1]), dtype=np.uint64)
                products = sliced_products(np.vstack([shifted, ones]))
                back = np.array([*least.tolist(), 0], dtype=object)
                sums, n = products[:, -1], products[-1, -1]
                products += np.outer(back, sums) + np.outer(sums, back) + n * np.outer(back, back)
                total += products
        upper = [(i, j) for i in range(dimensions + 1) for j in range(i, dimensions + 1)]
        cells = [int(total[i, j]) for i, j in upper]
        limbs = [[c >> _LIMB * k if k == _LIMBS - 1 else c >> _LIMB * k & (1 << _LIMB) - 1 for c in cells] for k in range(_LIMBS)]
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in upper], pa.int32()), pa.array([j for _, j in upper], pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)],
                ["i", "j", *(f"limb{k}" for k in range(_LIMBS))],
            )

    return run


def exact_products(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Whole-number sums over all rows of the products of entries; last the entries' sums and the count.

    The driver gets a row per two dimensions, whatever the number of vectors.
    """
    limbs = [f"limb{k}" for k in range(_LIMBS)]
    schema = "i int, j int, " + ", ".join(f"{x} bigint" for x in limbs)
    parts = vectors.select("embedding").mapInArrow(_scatter(dimensions), schema)
    sums = parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in limbs])
    total = np.zeros((dimensions + 1, dimensions + 1), dtype=object)
    for row in sums.collect():
        value = sum(row[x] << _LIMB * k for k, x in enumerate(limbs))
        total[row["i"], row["j"]] = total[row["j"], row["i"]] = value
    return total


def fit(products: np.ndarray, components: int) -> Model | None:
    """Components of the covariance, centred as whole numbers; None without any spread.

    Directions without spread, up to rounding, are no components. Of an eigenvector the
    entry of the largest size is positive.
    """
    n, sums = int(products[-1, -1]), [int(x) for x in products[:-1, -1]]
    if n == 0:
        return None
    centred = n * products[:-1, :-1] - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))
    covariance = np.array([[int(x) / (n * n) for x in row] for row in centred], dtype=np.float64)
    trace = int(np.trace(centred)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = np.nonzero(values > trace * len(values) * np.finfo(np.float64).eps)[0][:components]
    if not len(kept):
        return None
    values, vectors = values[kept], vectors[:, kept]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(kept))])
    # The squares of n * x - S add up to this over all rows.
    reach = max(int(centred[k, k]) * n for k in range(len(centred)))
    return Model(n, sums, values, vectors, trace, reach)


def _whitened(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        dimensions = len(model.sums)
        scaled = model.vectors / np.sqrt(model.values)
        narrow = model.reach * dimensions < 2**62 and max(map(abs, model.sums)) < 2**62
        sums = np.array(model.sums, dtype=np.int64 if narrow else object)
        for batch in batches:
            rows, entries = as_integers(batch.column("embedding"), dimensions)
            for at in range(0, len(rows), SLICE_ROWS):
                part = entries[at : at + SLICE_ROWS]
                off = (part if narrow else part.astype(object)) * model.n - sums
                squares = (off * off).sum(axis=1)
                if narrow:
                    deviation = pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([str(x) if x < 10**38 else None for x in squares]).cast(pa.decimal128(38, 0))
                found = (off / model.n).astype(np.float64) @ scaled
                flat = pa.array(found.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, found.shape[1], dtype=np.int32)), flat)
                ids = batch.column("vec_id").take(pa.array(rows[at : at + SLICE_ROWS]))
                yield pa.RecordBatch.from_arrays([ids, deviation, lists], ["vec_id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c is the whole number floor(1024 * c) + 100000; sizes of c beyond 2^52 are
    taken as that. ``deviation`` is the exact sum of (n * x - S)^2 as decimal(38,0),
    null where it does not fit. ``identity_error`` is the largest entry of the
    covariance of the whitened rows, measured over all of them, minus the identity.

    Null vectors, vectors with null or non-finite entries, and vectors of another
    length than the most common one (of equally common ones the longest) are left out.
    Repeated rows and ids count as often as they occur; null ids are kept. Directions
    without spread are no components, so equal vectors, a single one, vectors without
    entries and an empty table give no rows.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    lengths = rows.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("length")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    dimensions = common["length"] if common else 0
    model = fit(exact_products(rows, dimensions), components) if dimensions else None
    kind = dict(rows.dtypes)["vec_id"]
    columns = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], columns)
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # components times dimensions
    found = once(
        rows.mapInArrow(_whitened(sent), f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"), "whitened"
    )
    count = len(model.values)
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    measured = found.select(*[F.get("whitened", F.lit(k)).alias(f"w{k}") for k in range(count)])
    covariances = measured.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    error = max(abs(covariances[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

"""Quality classifier: linear hinge loss on n-gram indicators scaled by class log-count ratios.

The n-grams run over the forms of words rather than the words: letters by case,
digits, other characters as they are, and marks for a word like the one before,
a repeated word triple and a repeated line. Forms are few, so they are learnt
from few labels and hold for any language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.arrow import list_bounds, mixed, small_slices
from leakscope.llm.common import once, text_or_empty

BUCKETS = 2**18
LONGEST = 3
SMOOTHING = 1.0
#: Labelled rows the hinge-loss fit takes at most; the counts take all.
SAMPLE_ROWS = 20_000
COST = 1.0
EPOCHS = 30
THRESHOLD = 0.3

_TOKEN = r"[^\x20\x09-\x0D]+|\n"
_SAME, _TRIPLE, _LINE = (np.uint64(k) for k in (11, 12, 13))
_U = np.uint64


def _form(word: str) -> int:
    """Hash of the word's form: runs of one kind of character count once."""
    kinds, last = [], ""
    for c in word:
        kind = "x" if c.islower() else "X" if c.isupper() else "d" if c.isnumeric() else "x" if c.isalpha() else c
        if kind != last:
            kinds.append(kind)
            last = kind
    total = 14695981039346656037
    for c in kinds:
        total = (total ^ ord(c)) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return total


def _forms(column: pa.ListArray, known: dict[str, int]) -> Iterator[np.ndarray]:
    """The form codes of each text of a batch."""
    coded = column.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(known) > 300_000:
        known.clear()
    codes = np.array([known.get(w) or known.setdefault(w, _form(w)) for w in words], dtype=np.uint64)
    line_end = words.index("\n") if "\n" in words else -1
    every, bounds = coded.indices.to_numpy(), list_bounds(column)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        at = every[a:b]
        is_word = at != line_end
        forms = codes[at] if len(at) else np.zeros(0, np.uint64)
        ends = np.nonzero(~is_word)[0].tolist()
        repeated, seen = np.zeros(len(at), dtype=bool), set()
        for start, end in zip([0, *(e + 1 for e in ends)], [*ends, len(at)]):
            if end - start > 1:
                line = at[start:end].tobytes()
                repeated[start:end] = line in seen
                seen.add(line)
        at, forms, repeated = at[is_word].astype(np.uint64), forms[is_word], repeated[is_word]
        if len(at) > 2:
            triples = mixed(mixed(at[:-2] + _U(1)) * _U(3) + mixed(at[1:-1] + _U(2)) * _U(5) + mixed(at[2:] + _U(3)))
            _, first = np.unique(triples, return_index=True)
            again = np.ones(len(triples), dtype=bool)
            again[first] = False
            forms[2:][again] = _TRIPLE
        if len(at) > 1:
            forms[1:][at[1:] == at[:-1]] = _SAME
        forms[repeated] = _LINE
        yield forms


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in small_slices(batches):
        found = []
        for forms in _forms(batch.column("tokens"), known):
            grams, total = [], np.zeros(len(forms), dtype=np.uint64)
            for n in range(1, LONGEST + 1):
                total = mixed(total[: len(forms) - n + 1] * _U(31) + forms[n - 1 :] + _U(n)) if len(forms) >= n else total[:0]
                grams.append(total % _U(BUCKETS))
            found.append(np.unique(np.concatenate(grams)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "features"])


def indicators(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the set of its n-gram indicators, hashed to a fixed number of places."""
    tokens = F.regexp_extract_all(text_or_empty(text), F.lit(_TOKEN), F.lit(0)).alias("tokens")
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), tokens).mapInArrow(
        _features, "doc_id bigint, features array<int>"
    )


def log_count_ratios(counts: dict[int, np.ndarray], rows: dict[int, int]) -> np.ndarray:
    """Log ratio of the shares of the two classes' rows that hold an indicator, smoothed."""
    share = {k: (SMOOTHING + counts[k]) / (2 * SMOOTHING + rows[k]) for k in (0, 1)}
    return np.log(share[1] / share[0])


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the scaled indicators and, last, of a constant, by dual coordinate descent.

    Each row is scaled to unit length, so long texts weigh no more than short ones.
    Both classes weigh the same in sum.
    """
    signs = np.where(labels > 0, 1.0, -1.0)
    bounds = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())) * cost * len(rows)
    weights, dual = np.zeros(len(scale) + 1), np.zeros(len(rows))
    values = [unit(scale[r]) for r in rows]
    squares = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            slope = signs[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1.0
            new = min(max(dual[i] - slope / squares[i], 0.0), bounds[i])
            step = (new - dual[i]) * signs[i]
            if step:
                most = max(most, abs(step))
                weights[rows[i]] += step * values[i]
                weights[-1] += step
                dual[i] = new
        if most < 1e-4:
            break
    return weights


def unit(values: np.ndarray) -> np.ndarray:
    length = math.sqrt(float(values @ values))
    return values / length if length > 0 else values


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the margins, by Newton steps on smoothed targets."""
    positive = float(labels.sum())
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        grad = np.array([(p - target) @ margins + 1e-3 * slope, (p - target).sum() + 1e-3 * shift])
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[w @ margins**2 + 1e-3, w @ margins], [w @ margins, w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        size = float(np.abs(step).max())
        slope, shift = slope - step[0] / max(1.0, size), shift - step[1] / max(1.0, size)
        if size < 1e-8:
            break
    return float(slope), float(shift)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, float] | None:
    """Weights per indicator with the ratios multiplied in, slope and shift; None without two classes.

    ``labelled`` has doc_id, features and label. The class counts of all rows are
    summed in Spark, at most two numbers per place; the fit takes the rows with the
    smallest hashes of their ids, at most ``sample_rows``.
    """
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):
        return None
    table = labelled.select("label", F.explode("features").alias("feature")).groupBy("label", "feature").count().toArrow()
    label, feature, count = (table[c].to_numpy() for c in ("label", "feature", "count"))
    counts = {k: np.zeros(BUCKETS) for k in (0, 1)}
    for k in (0, 1):
        counts[k][feature[label == k]] = count[label == k]
    ratios = log_count_ratios(counts, totals)
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows).select("features", "label").toArrow()
    rows = [np.array(x, dtype=np.int64) for x in sample["features"].to_pylist()]
    labels = sample["label"].to_numpy()
    weights = fit_hinge(rows, labels, ratios)
    margins = np.array([weights[r] @ unit(ratios[r]) + weights[-1] for r in rows])
    return (np.vstack([weights[:-1], ratios]), float(weights[-1]), *fit_sigmoid(margins, labels))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(len(batch), 0.5)
            if model.value is not None and len(batch):
                (weights, ratios), constant, slope, shift = model.value
                column = batch.column("features")
                bounds, flat = list_bounds(column), column.flatten().to_numpy()
                sums = np.zeros((2, len(flat) + 1))
                np.cumsum(weights[flat] * ratios[flat], out=sums[0, 1:])
                np.cumsum(ratios[flat] ** 2, out=sums[1, 1:])
                product, square = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                margin = product / np.sqrt(np.maximum(square, 1e-12)) + constant
                scores = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def is_held_out(doc_id: str) -> Column:
    """Rows kept out of training; a null id is never one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def score(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Only labels of rows that are not held out are learnt from. Of an id with several
    labels the lowest counts; null labels and ids are left out. Repeated rows are
    scored alike, null and empty texts by the constant alone. Without labels of both
    classes every score is 0.5. An empty table gives no rows.
    """
    found = once(indicators(docs, doc_id, text), "indicators")
    known = labels.groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~is_held_out("doc_id"))
    model = train(once(found.join(known, "doc_id"), "labelled"), sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two numbers per place, 4 MB
    scored = found.mapInArrow(_scored(sent), "doc_id bigint, score double")
    return scored.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

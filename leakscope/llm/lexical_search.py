"""Ranked lexical search by branch and bound over trees of documents.

For an item the documents of a chunk are restricted to its terms. These vectors,
sorted by frequency with the rarest term first, share the paths of a trie; documents
with the same terms end in one leaf. Each node knows the largest count of every term
and the smallest length factor below it, which bound the score of all documents
there, so the search leaves out whole subtrees once it has enough better documents.
Rarest first, as the subtrees then part by the heavy terms.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.arrow import small_slices
from leakscope.llm.common import once, text_or_empty

TOP = 20
#: Terms of documents that a chunk holds, and documents.
CHUNK_TERMS, CHUNK_DOCS = 4_000_000, 50_000
#: Terms of items that one pass over the documents looks for.
BLOCK_TERMS = 1_000_000
#: Nodes that a search looks at in one step.
STEP = 256
#: Into how many parts an item's candidates fall before the last choice.
PARTS = 64

# Terms are runs of ASCII letters and digits and of all characters beyond ASCII;
# in UTF-8 every byte of the latter is 128 or more.
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
_TABLE = bytes((k + 32 if 65 <= k <= 90 else k) if k in _KEEP else 32 for k in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def length_factor(terms: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 100 - 25 + (25 * terms * documents) // total


def saturated(count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """A term's share of its weight; it rises with the count and falls with the factor."""
    return (1_000_000_000 * count) // (1000 * count + 12 * factor)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Query(NamedTuple):
    """An item: its terms, the rarest first, and for each the weight times its repeats."""

    item_id: int
    terms: np.ndarray
    weights: np.ndarray


class Chunk:
    """Documents and where each term occurs in them."""

    def __init__(self, ids: np.ndarray, factors: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_terms: int):
        self.ids, self.factors = ids, factors
        by_term = np.argsort(terms, kind="stable")
        self.docs, self.counts = np.repeat(np.arange(len(ids)), sizes)[by_term], counts[by_term]
        self.bounds = np.searchsorted(terms[by_term], np.arange(n_terms + 1))


class Tree:
    """The trie of a chunk's documents, restricted to one item's terms.

    A document is a row of bits, the rarest term's first, and sorted rows put those
    that share a path side by side. Level by level the nodes are the different
    beginnings of 0, 2, 4, 8 and so on terms; those of the last level, the leaves, are
    the different rows. ``most`` has a row of count maxima and ``factor`` the smallest
    length factor per node.
    """

    def __init__(self, chunk: Chunk, terms: np.ndarray):
        size = len(terms)
        low, high = chunk.bounds[terms], chunk.bounds[terms + 1]
        at, of_term = _ranges(low, high)
        docs, counts = chunk.docs[at], chunk.counts[at]
        bits = np.zeros((len(chunk.ids), -(-size // 64)), dtype=np.uint64)
        ends = np.cumsum(high - low)
        for k, (a, b) in enumerate(zip((ends - (high - low)).tolist(), ends.tolist())):
            bits[docs[a:b], k // 64] |= np.uint64(1 << 63 - k % 64)
        held = np.nonzero(bits.any(axis=1))[0]
        order = held[np.lexsort(bits[held].T[::-1])]
        rows = bits[order]
        slot = np.empty(len(chunk.ids), dtype=np.int64)
        slot[order] = np.arange(len(order))
        self.ids, self.factors = chunk.ids[order], chunk.factors[order]
        # Occurrences by document, for exact scores.
        slots = slot[docs]
        by_slot = np.argsort(slots, kind="stable")
        self.terms, self.counts = of_term[by_slot], counts[by_slot]
        self.places = np.searchsorted(slots[by_slot], np.arange(len(order) + 1))
        differ = rows[1:] ^ rows[:-1]
        first = _starts((differ != 0).any(axis=1), len(order))
        leaf_of = np.cumsum(np.bincount(first, minlength=len(order))) - 1
        most = np.zeros((len(first), size), dtype=np.int64)
        np.maximum.at(most, (leaf_of[slots], of_term), counts)
        self.most, self.factor = [most], [np.minimum.reduceat(self.factors, first) if len(first) else self.factors]
        #: Bounds of each node's children, or of a leaf's documents.
        self.children = [np.append(first, len(order))]
        differ, cuts = differ[first[1:] - 1], [0]
        while max(2, 2 * cuts[-1]) < size:
            cuts.append(max(2, 2 * cuts[-1]))
        finer = np.arange(len(first))
        for cut in reversed(cuts):
            mask = np.array([_leading(cut - 64 * k) for k in range(bits.shape[1])], dtype=np.uint64)
            starts = _starts((differ & mask != 0).any(axis=1), len(first))
            inner = np.searchsorted(finer, starts)  # in nodes of the level below
            self.children.append(np.append(inner, len(finer)))
            if len(inner):
                most = np.maximum.reduceat(most, inner, axis=0)
                self.factor.append(np.minimum.reduceat(self.factor[-1], inner))
            else:
                self.factor.append(self.factor[-1])
            self.most.append(most)
            finer = starts


def _leading(count: int) -> int:
    """A word of so many leading ones."""
    count = min(max(count, 0), 64)
    return (1 << 64) - (1 << 64 - count)


def _starts(differs: np.ndarray, count: int) -> np.ndarray:
    """Where a run begins, of rows of which each but the first is known to differ from the one before."""
    return np.concatenate([[0], np.nonzero(differs)[0] + 1]) if count else np.zeros(0, dtype=np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each comes from."""
    sizes = high - low
    source = np.repeat(np.arange(len(low)), sizes)
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), source


class Best:
    """The highest scores so far, equal ones by ascending id."""

    def __init__(self, size: int):
        self.size, self.heap = size, []

    def least(self) -> int:
        """A score below this one cannot get in."""
        return self.heap[0][0] if len(self.heap) == self.size else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = scores >= self.least()
        for found in zip(scores[fits].tolist(), (-ids[fits]).tolist()):
            if len(self.heap) < self.size:
                heapq.heappush(self.heap, found)
            elif found > self.heap[0]:
                heapq.heapreplace(self.heap, found)


def search(tree: Tree, weights: np.ndarray, best: Best) -> None:
    """Offer every document of the tree that can get into the best.

    The stack holds blocks of nodes of one level with their bounds; of a node's
    children the block of the highest bounds is on top.
    """

    def score(leaves: np.ndarray) -> None:
        docs, _ = _ranges(tree.children[0][leaves], tree.children[0][leaves + 1])
        at, of = _ranges(tree.places[docs], tree.places[docs + 1])
        total = np.zeros(len(docs), dtype=np.int64)
        np.add.at(total, of, weights[tree.terms[at]] * saturated(tree.counts[at], tree.factors[docs[of]]))
        best.offer(total, tree.ids[docs])

    def push(level: int, nodes: np.ndarray) -> None:
        bounds = (weights * saturated(tree.most[level][nodes], tree.factor[level][nodes][:, None])).sum(axis=1)
        order = np.argsort(bounds)
        order = order[np.searchsorted(bounds[order], best.least()) :]
        for k in range(len(order) % STEP - STEP, len(order), STEP):
            chosen = order[max(k, 0) : k + STEP]
            if len(chosen):
                stack.append((level, nodes[chosen], bounds[chosen]))

    stack: list[tuple[int, np.ndarray, np.ndarray]] = []
    top = len(tree.most) - 1
    push(top, np.arange(len(tree.most[top])))
    while stack:
        level, nodes, bounds = stack.pop()
        nodes = nodes[bounds >= best.least()]
        if not len(nodes):
            continue
        if level == 0:
            score(nodes)
        else:
            push(level - 1, _ranges(tree.children[level][nodes], tree.children[level][nodes + 1])[0])


def _restricted(sent):
    """doc, n and the terms that items ask for, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value.get
        for batch in small_slices(batches):
            lengths, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                known = np.array([k for k in map(code, words) if k is not None], dtype=np.int32)
                found, often = np.unique(known, return_counts=True)
                lengths.append(len(words))
                terms.append(found)
                counts.append(often.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["doc", "n", "terms", "counts"],
            )

    return run


def _chunks(batches: Iterator[pa.RecordBatch], n_terms: int, documents: int, total: int) -> Iterator[Chunk]:
    held: list[tuple[np.ndarray, ...]] = []
    docs = places = 0
    for batch in small_slices(batches):
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        columns = (batch.column(c).to_numpy() for c in ("doc", "n"))
        held.append((*columns, sizes, *(batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))))
        docs, places = docs + len(batch), places + int(sizes.sum())
        if places >= CHUNK_TERMS or docs >= CHUNK_DOCS:
            ids, lengths, *rest = map(np.concatenate, zip(*held))
            yield Chunk(ids, length_factor(lengths, documents, total), *rest, n_terms)
            held, docs, places = [], 0, 0
    if docs:
        ids, lengths, *rest = map(np.concatenate, zip(*held))
        yield Chunk(ids, length_factor(lengths, documents, total), *rest, n_terms)


def _searched(sent, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_terms, documents, total = sent.value
        best = [Best(top) for _ in queries]
        for chunk in _chunks(batches, n_terms, documents, total):
            for query, found in zip(queries, best):
                search(Tree(chunk, query.terms), query.weights, found)
        rows = [(q.item_id, -i, s) for q, found in zip(queries, best) for s, i in found.heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item_id", "doc_id", "score"]
        )

    return run


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, term and how often an item's different texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            found = [terms_of(t) for t in batch.column("text").to_pylist()]
            of = [i for i, words in zip(batch.column("item_id").to_pylist(), found) for _ in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), pa.array([w for words in found for w in words], pa.binary())], ["item_id", "term"]
            )

    texts = items.select(F.col(item_id).cast("bigint").alias("item_id"), text_or_empty(text).alias("text"))
    texts = texts.where("item_id IS NOT NULL").distinct()
    return texts.mapInArrow(run, "item_id bigint, term binary").groupBy("item_id", "term").agg(F.count("*").alias("often"))


def _block(docs: DataFrame, item_terms: DataFrame, top: int) -> DataFrame:
    """The best documents per task for one block of items."""
    context = docs.sparkSession.sparkContext
    asked = item_terms.toArrow()  # at most about BLOCK_TERMS rows, or one item
    terms = sorted(set(asked["term"].to_pylist()))
    code = {t: k for k, t in enumerate(terms)}
    vectors = once(docs.mapInArrow(_restricted(context.broadcast(code)), "doc bigint, n bigint, terms array<int>, counts array<int>"), "term-vectors")
    sizes = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = sizes["documents"], sizes["total"] or 0
    holding = np.zeros(len(terms), dtype=np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[row["term"]] = row["count"]
    of_item: dict[int, list[tuple[int, int, int]]] = {}
    for item, term, often in zip(*(asked[c].to_pylist() for c in ("item_id", "term", "often"))):
        k = code[term]
        if holding[k]:
            of_item.setdefault(item, []).append((int(holding[k]), k, often * term_weight(documents, int(holding[k]))))
    queries = []
    for item, rows in sorted(of_item.items()):
        _, codes, weights = (np.array(x, dtype=np.int64) for x in zip(*sorted(rows)))
        queries.append(Query(item, codes, weights))
    sent = context.broadcast((queries, len(terms), documents, max(total, 1)))
    found = vectors.where("doc IS NOT NULL AND size(terms) > 0").mapInArrow(_searched(sent, top), "item_id bigint, doc_id bigint, score bigint")
    return found.withColumn("part", F.spark_partition_id() % PARTS)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents by weighted, saturated term counts.

    Equal scores rank by ascending doc_id. Every document is searched, exactly; trees,
    tails and bounds only leave out what cannot get in. Items are looked for in blocks
    of about ``block_terms`` of their terms, which are broadcast; the documents are
    read once per block.

    Null and empty texts have no terms. Items without an id or without terms have no
    rows; rows of one item id are one item of all their different texts. Documents
    without an id count in the statistics but are not ranked; rows that share an id are
    documents of their own. Texts are taken whole, however long. Empty tables give no
    rows.
    """
    asked = once(_item_terms(items, item_id, item_text), "item-terms")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), text_or_empty(text).alias("text"))
    found = None
    for k in range(blocks):
        part = _block(texts, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), top)
        found = part if found is None else found.union(part)
    best = [F.desc("score"), F.asc("doc_id")]
    # First within parts of an item's candidates, so that no task takes all of them.
    few = found.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*best))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")

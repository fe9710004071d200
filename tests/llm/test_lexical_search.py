import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
from cases import awkward, documents
from pyspark.sql import functions as F

from leakscope.llm import lexical_search

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [regex.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, top=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in found if c)
    total = sum(sum(c.values()) for _, c in found)
    holding = Counter(t for _, c in found for t in c)
    texts = {}
    for item, text in set(items):
        if item is not None:
            texts.setdefault(item, Counter()).update(terms(text))
    rows = []
    for item, asked in texts.items():
        scored = []
        for doc, counts in found:
            m = 75 + (25 * sum(counts.values()) * n_docs) // max(total, 1)
            score = sum(
                often * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t, often in asked.items()
                if counts[t]
            )
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        rows += [(item, k, doc, -s) for k, (s, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(rows)


def items(spark, rows):
    clashing = {c: F.lit("own") for c in ("rank", "score", "doc_id", "often", "term", "part", "place")}
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumns(clashing)


def corpus(seed, count, words=60):
    rng = random.Random(seed)
    some = [f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(some, k=rng.randint(0, 40)))) for i in range(count)]


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, seed):
    docs = corpus(seed, 400)
    docs += [(1000 + k, docs[7][1]) for k in range(90)]  # ties by the dozen
    asked = corpus(seed + 10, 12) + [(50, docs[7][1]), (51, "w1 w1 w1 W1"), (52, "unheard")]
    found = lexical_search.ranked_search(documents(spark, docs).repartition(5), items(spark, asked))
    assert sorted(map(tuple, found.collect())) == plain(docs, asked)


def test_trees_and_blocks_of_any_size(spark, monkeypatch):
    docs, asked = corpus(5, 300), corpus(6, 9)
    monkeypatch.setattr(lexical_search, "CHUNK_DOCS", 1)
    found = lexical_search.ranked_search(documents(spark, docs).repartition(3), items(spark, asked), top=3, block_terms=20)
    assert sorted(map(tuple, found.collect())) == plain(docs, asked, 3)


def test_bounds_leave_documents_out():
    """Beside copies of the item little is scored."""
    rng = np.random.default_rng(0)
    vectors = [np.unique(np.minimum(rng.zipf(1.3, 30), 300)) for _ in range(2000)]
    vectors += [vectors[3]] * 10
    sizes = np.array([len(v) for v in vectors])
    chunk = lexical_search.Chunk(np.arange(2010), np.full(2010, 100), sizes, np.concatenate(vectors), np.ones(sizes.sum(), dtype=np.int64), 301)
    terms = vectors[3][::-1].astype(np.int64)
    best, seen = lexical_search.Best(5), []
    best.offer = lambda scores, ids, offer=best.offer: (seen.append(len(ids)), offer(scores, ids))[1]
    lexical_search.search(lexical_search.Tree(chunk, terms), 100 + 19 * terms, best)
    assert sorted(-i for _, i in best.heap) == [3, 2000, 2001, 2002, 2003]
    assert sum(seen) < 600


def test_awkward_rows(spark):
    docs = [*awkward(), (11, "É é ÉCOLE x1-y2_Z"), (12, "a" * 200_000), (13, "!?"), (14, "école Dog x")]
    asked = [(1, "the quick fox"), (1, "the quick fox"), (1, "lazy dog"), (None, "fox"), (2, None), (3, ""), (4, "école É Y2"), (5, "ab5999 " * 3000), (6, "a" * 200_000)]
    found = lexical_search.ranked_search(documents(spark, docs), items(spark, asked))
    assert sorted(map(tuple, found.collect())) == plain(docs, asked)


@pytest.mark.parametrize("docs, asked", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, asked):
    assert lexical_search.ranked_search(documents(spark, docs), items(spark, asked)).count() == 0

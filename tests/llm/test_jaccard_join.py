import random

import cases

from leakscope.llm import jaccard_join
from leakscope.llm.common import components


def brute(rows):
    sets, first = {}, {}
    for doc, text in rows:
        words = (text or "").lower().split()
        if doc is not None:
            sets[doc] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None
    for doc in sorted(sets):
        if sets[doc] is not None:
            first.setdefault(sets[doc], doc)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    known, links = list(first), dict.fromkeys(first, 0)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            shared = len(a & b)
            if 5 * shared >= 4 * (len(a) + len(b) - shared):
                links[a] += 1
                links[b] += 1
                x, y = top(first[a]), top(first[b])
                up[max(x, y)] = min(x, y)
    return {d: (first[s], top(first[s]), links[s]) if s is not None else (d, d, 0) for d, s in sets.items()}


def corpus(seed=1, n=900):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    hot, shared = r.choices(words, k=120), r.choices(words, k=60)
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.35:
            text = list(hot)
            for _ in range(r.randint(0, 5)):
                text[r.randrange(120)] = r.choice(words)
        elif kind < 0.6:
            text = shared + r.choices(words, k=r.randint(0, 60))
        elif kind < 0.7:
            text = r.choices(words[:3], k=r.randint(0, 6))
        else:
            text = r.choices(words, k=r.randint(1, 200))
        rows.append((3 * i, " ".join(text)))
    return rows + [(rows[1][0], rows[1][1]), (None, rows[2][1]), (90001, None), (90002, ""), (90003, " \n")]


def test_links_and_classes_match_brute_force(spark):
    rows = corpus()
    found = jaccard_join.near_duplicates(cases.documents(spark, rows).repartition(4))
    assert {r.doc_id: (r.text_id, r.class_id, r.n_links) for r in found.collect()} == brute(rows)


def test_crowded_paths_are_split_and_large_groups_cut_into_blocks(spark, monkeypatch):
    rows = corpus(2, 300)
    monkeypatch.setattr(jaccard_join, "BUCKET", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    found = jaccard_join.near_duplicates(cases.documents(spark, rows)).collect()
    assert {r.doc_id: (r.text_id, r.class_id, r.n_links) for r in found} == brute(rows)


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark, cases.awkward())
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # 6 repeats the words of 1 within one more set; the two rows without an id stay.
    assert ids == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_runs_follow_the_recall():
    assert jaccard_join.runs_for(0.5) == 1
    assert jaccard_join.runs_for(0.9999) == 11
    assert jaccard_join.runs_for(0.999999) > 11


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)}


def test_every_different_text_of_a_repeated_id_stays(spark):
    one, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, one), (1, other), (2, "x y z"), (2, None), (2, ""), (None, one), (None, one)]
    kept = jaccard_join.keep_one(cases.documents(spark, rows))
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(1, one), (1, other), (2, "x y z"), (2, ""), (None, one), (None, one)], key=str)
    assert kept.columns == cases.documents(spark, rows).columns

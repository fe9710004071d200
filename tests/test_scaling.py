import math
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from leakscope.operators import contamination, dedup, embeddings
from leakscope.operators.embeddings import nearest_vectors
from leakscope.operators.scaling import lookup_join, running_sums


def test_lookup_join_with_one_key_in_a_third_of_the_rows(spark):
    keys = ["hot"] * 1000 + [f"k{i}" for i in range(2000)] + [None]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    counts = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    dictionary = counts.where("k != 'k7'").withColumn("size", F.length("k"))
    got = {r["id"]: r["size"] for r in lookup_join(rows, dictionary, ["k"], "n", "id").collect()}
    assert len(got) == 3001
    assert all(got[i] == (None if k in (None, "k7") else len(k)) for i, k in enumerate(keys))


def test_hot_rows_are_spread_over_many_keys(spark):
    rows = spark.createDataFrame([(i, "hot") for i in range(2000)], "id int, k string")
    dictionary = spark.createDataFrame([("hot", 2000, 1)], "k string, n int, v int")
    plan = lookup_join(rows, dictionary, ["k"], "n", "id")
    assert plan.where("v = 1").count() == 2000


@pytest.mark.parametrize("chunk", [3, 100])
def test_running_sums_do_not_depend_on_the_chunk(spark, chunk):
    rows = [("a", i, i % 5) for i in range(20)] + [("b", i, 1) for i in range(7)]
    table = spark.createDataFrame(rows, "key string, pos int, v int")
    got = running_sums(table, "key", "pos", {"total": F.col("v")}, chunk_rows=chunk)
    by_key = {k: [r["total"] for r in sorted(got.where(F.col("key") == k).collect(), key=lambda r: r["pos"])] for k in "ab"}
    assert by_key["a"] == list(accumulate(i % 5 for i in range(20)))
    assert by_key["b"] == list(range(1, 8))


def grams(text, n):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5])
def test_contamination_against_brute_force(spark, threshold):
    boiler = "all rights reserved by the owner of this text"
    items = [(i, f"{boiler} w{i} x{i} y{i} z{i} {boiler if i % 2 else ''} u{i} v{i}") for i in range(12)]
    items += [(50, items[0][1]), (51, "short"), (52, boiler)]
    docs = [(i, f"p{i} q{i} {boiler} r{i}") for i in range(30)]
    docs += [(100 + i, f"a b {items[i][1][: 30 + 4 * i]} c {items[i][1]}") for i in range(6)]
    docs += [(200 + i, f"x{i} y{i} z{i} {boiler}") for i in range(12)]
    found = contamination.corpus_contamination(
        spark.createDataFrame(items, "item_id bigint, text string"),
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        n=3,
        threshold=threshold,
    )
    got = {(r["item_id"], r["doc_id"]): (r["overlap_count"], r["ref_count"]) for r in found.collect()}
    expected = {}
    for i, item in items:
        for d, doc in docs:
            mine, theirs = grams(item, 3), grams(doc, 3)
            if mine and len(mine & theirs) / len(mine) > threshold:
                expected[i, d] = (len(mine & theirs), len(mine))
    assert got == expected and expected
    assert found.count() == len(expected)


def test_contamination_with_one_gram_in_all_documents(spark):
    hot = "all rights reserved"
    items = [(0, hot), (1, f"{hot} by me"), (2, f"one two three {hot}"), (3, None), (4, "")]
    docs = [(i, f"p{i} {hot} q{i} {hot}") for i in range(3000)]
    docs += [(3000, f"One, two three; {hot}!"), (3001, None), (3002, ""), (3003, "two"), (3004, "x y z " * 20_000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = contamination.corpus_contamination(
            spark.createDataFrame(items, "item_id bigint, text string"),
            spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
            n=3,
        )
        got = {(r["item_id"], r["doc_id"]): (r["overlap_count"], r["ref_count"]) for r in found.collect()}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = {}
    for i, item in items[:3]:
        for d, doc in docs:
            mine = grams(item, 3)
            both = len(mine & grams((doc or "").lower().replace(",", "").replace(";", "").replace("!", ""), 3))
            if both / len(mine) > 0.3:
                expected[i, d] = (both, len(mine))
    assert got == expected and len(got) == 3001 * 2 + 1
    assert "collect_list" not in plan and "array_join" not in plan


def test_nearest_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    matrix = np.round(rng.normal(size=(90, 6)), 2)
    matrix[5] = matrix[9]
    matrix[11] = 0.0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = nearest_vectors(table, table, k=4, exclude_same_id=True, block_rows=16).collect()
    single = np.float32(matrix).astype(float)
    unit = single / np.maximum(np.linalg.norm(single, axis=1, keepdims=True), 1e-8)
    cosines = np.round(unit @ unit.T, 6)
    for q in range(90):
        order = sorted((j for j in range(90) if j != q), key=lambda j: (-cosines[q, j], j))[:4]
        mine = sorted((r for r in got if r["vec_id"] == q), key=lambda r: r["rank"])
        assert [r["neighbour_id"] for r in mine] == order


def test_score_by_duplication_with_many_copies(spark):
    texts = [(i, "Same  text") for i in range(9)] + [(20, "same text\n"), (30, "other")]
    scores = [(0, 1.0), (30, 0.5)]
    got = dedup.score_by_duplication(
        spark.createDataFrame(texts, "doc_id bigint, text string"),
        spark.createDataFrame(scores, "doc_id bigint, leak_score double"),
        "doc_id",
        "text",
    )
    rows = {r["copies_band"]: (r["distinct_texts"], r["texts"], r["avg_score"]) for r in got.collect()}
    assert rows == {3: (1, 10, 0.1), 0: (1, 1, 0.5)}


def test_dedup_keeps_the_first_of_each_group(spark):
    texts = [(3, "a b"), (1, "A  b "), (2, "c")]
    kept = dedup.exact_dedup(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_a_vector_with_nan_takes_no_place(spark):
    rows = [(i, [1.0, float(i)]) for i in range(6)] + [(9, [float("nan"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = nearest_vectors(table.where("vec_id < 6"), table, k=2, exclude_same_id=True, block_rows=16).collect()
    assert len(found) == 12 and 9 not in {r["neighbour_id"] for r in found}


def test_vectors_travel_as_floats_to_few_blocks(spark):
    from leakscope.operators import embeddings

    table = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    sent = embeddings._replicated(table.where("vec_id < 10"), "qb", F.lit(8), "rb", embeddings._block_count(table, embeddings.BLOCK_ROWS))
    assert sent.count() == 80 and dict(sent.dtypes)["embedding"] == "array<float>"


def test_strips_give_the_same_neighbours(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from leakscope.operators import embeddings

    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"vec_id": range(40), "embedding": [v for v in rng.normal(size=(40, 5)).astype(np.float32)]})
    whole = embeddings._cell_top(frame, frame, 3, True)
    monkeypatch.setattr(embeddings, "STRIP_ROWS", 7)
    assert embeddings._cell_top(frame, frame, 3, True).equals(whole) and len(whole) == 120


def test_text_vectors_deal_texts_and_rare_terms(spark):
    rows = [(1, "a b b c"), (1, "b d"), (2, "a zz"), (3, None), (None, "a yy"), (None, "yy"), (4, "a"), (5, "")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    asked = embeddings.text_vectors(texts, "doc_id", "text", common_share=0.15)
    # The terms of a text are counted where it is, not dealt by text and term.
    plan = asked._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line.split("Exchange ")[1] for line in plan if "Exchange hashpartitioning" in line]
    assert any("REPARTITION_BY_NUM" in line for line in dealt) and not any(", term#" in line for line in dealt)
    got = {(r.doc_id, r.term): r.weight for r in asked.collect()}
    counts = {}
    for i, text in rows:
        for term in (text or "").split():
            counts.setdefault(i, Counter())[term] += 1
    df = Counter(term for _, text in rows for term in set((text or "").split()))
    raw = {i: {t: n * math.log((len(rows) + 1) / (df[t] + 1)) for t, n in terms.items()} for i, terms in counts.items()}
    want = {(i, t): v / math.sqrt(sum(x * x for x in terms.values())) for i, terms in raw.items() for t, v in terms.items()}
    assert got == pytest.approx(want)
    for share in (0.0, 1.0):
        assert {(r.doc_id, r.term): r.weight for r in embeddings.text_vectors(texts, "doc_id", "text", common_share=share).collect()} == pytest.approx(want)

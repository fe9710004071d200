import pytest
from pyspark.sql import functions as F

from leakscope.operators import consistency, detail, embeddings, entities, logprobs, ngrams, prompts, tabular, verdict
from leakscope.operators.membership import membership_scores
from leakscope.plans import queries

ITEM = "item_id bigint, question string, options array<string>"


def test_outputs_vote_first_and_methods_then(spark):
    rows = [
        (1, "1-1", "ngram", 0.9, True, 0.3, None),
        (1, "1-2", "ngram", 0.1, False, 0.3, None),
        (1, "1-3", "ngram", None, None, 0.3, "malformed"),
        (1, None, "perplexity", 0.2, False, 1.5, None),
        (2, "2-1", "ngram", None, None, 0.3, "no_choices"),
        (2, "2-2", "ngram", None, None, 0.3, "malformed"),
        (3, "3-1", "ngram", 0.0, False, 0.3, None),
        (3, "3-2", "ngram", 0.0, False, 0.3, None),
        (3, "3-3", "ngram", 0.6, True, 0.3, None),
    ]
    names = "item_id bigint, response_id string, method string, memorization_score double, is_memorized boolean, threshold double, error string"
    per_method = verdict.method_verdicts(spark.createDataFrame(rows, names)).cache()
    got = {(r.item_id, r.method): (r.memorization_score, r.is_memorized, r.error, r.outputs, r.failed) for r in per_method.collect()}
    assert got == {
        (1, "ngram"): (0.5, True, None, 3, 1),
        (1, "perplexity"): (0.2, False, None, 1, 0),
        (2, "ngram"): (None, None, "malformed", 2, 2),
        (3, "ngram"): (pytest.approx(0.2), False, None, 3, 0),
    }
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id bigint")
    verdicts = {r.item_id: (r.aggregate_score, r.is_memorized) for r in verdict.aggregate_verdict(items, per_method).collect()}
    # Three outputs of one method weigh no more than one of another.
    assert verdicts == {1: (0.35, True), 2: (0.0, False), 3: (pytest.approx(0.2), False), 4: (0.0, False)}


def test_each_output_is_held_against_its_own_item(spark):
    outputs = spark.createDataFrame([(1, "a", "the cat sat on the mat"), (1, "b", "dogs bark"), (2, "c", "the cat sat")], "item_id bigint, response_id string, completion string")
    references = spark.createDataFrame([(1, 0, "the cat sat"), (1, 1, "a dog"), (2, 0, "blue sky here")], "item_id bigint, ref_idx int, reference string")
    keys = ("response_id",)
    overlaps = ngrams.ngram_overlap(outputs, references, sizes=(2,), keys=keys)
    judged = ngrams.ngram_verdict(ngrams.ngram_by_size(overlaps, keys), keys=keys)
    assert {(r.item_id, r.response_id): r.memorization_score for r in judged.collect()} == {(1, "a"): 1.0, (1, "b"): 0.0, (2, "c"): 0.0}
    options = references.withColumnsRenamed({"ref_idx": "option_idx", "reference": "option"})
    found = {(r.response_id, r.option_idx): r.similarity for r in logprobs.output_similarities(options, outputs).collect()}
    assert set(found) == {("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)}
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    x, y = pairs("the cat sat on the mat"), pairs("the cat sat")
    assert found["a", 0] == pytest.approx(2 * len(x & y) / (len(x) + len(y)))
    assert found["b", 1] > found["b", 0]


def test_ngram_overlap_worked_by_hand(spark):
    outputs = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id bigint, completion string")
    references = spark.createDataFrame([(1, 0, "the cat sat")], "item_id bigint, ref_idx int, reference string")
    overlaps = ngrams.ngram_overlap(outputs, references)
    rows = {r["n"]: r for r in overlaps.collect()}
    assert (rows[2]["overlap_count"], rows[2]["overlap_ratio"]) == (2, 1.0)
    assert rows[4]["overlap_ratio"] is None
    by_size = {r["n"]: r["max_overlap_ratio"] for r in ngrams.ngram_by_size(overlaps).collect()}
    assert by_size[4] == 0.0
    assert ngrams.ngram_verdict(ngrams.ngram_by_size(overlaps)).first()["is_memorized"]


@pytest.mark.parametrize("options", [["a", "b"], ["a", "b", "c", "d"], ["x", "x"], ["only"], []])
def test_reordered_prompts_are_permutations(spark, options):
    items = spark.createDataFrame([(i, "Q", options) for i in range(40)], ITEM)
    for r in prompts.trial_plan(items, trials=5, types=("reordered",)).collect():
        assert sorted(r["options_shown"]) == sorted(options)
        if len(options) > 1:
            assert r["shown_order"] != list(range(len(options)))


def test_rephrased_prompts_lower_the_question_and_keep_the_options(spark):
    items = spark.createDataFrame([(1, "What IS it", ["A1", "B1"])], ITEM)
    row = prompts.trial_plan(items, trials=1, types=("rephrased",)).first()
    assert row["options_shown"] == ["A1", "B1"] and "what is it" in row["prompt"]


def test_requests_per_item(spark):
    items = spark.createDataFrame([(1, "Q", ["a", "b", "c", "d"])], ITEM)
    assert prompts.request_table(items, "m").count() == 12
    assert prompts.request_table(items, "m", methods=("ngram",)).count() == 1


def test_trial_answers_map_back_to_the_last_equal_option(spark):
    rows = [
        (1, 1, "reordered", ["x", "y", "x"], ["y", "x", "x"], "B. x"),
        (1, 2, "rephrased", ["x", "y", "x"], ["x", "y", "x"], "B. y"),
        (1, 3, "both", ["x", "y"], ["y", "x"], "D. none"),
        (1, 4, "both", ["x", "y"], ["y", "x"], "no idea"),
    ]
    table = spark.createDataFrame(
        rows,
        "item_id bigint, trial int, modification_type string, options array<string>, "
        "options_shown array<string>, answer_text string",
    )
    got = {r["trial"]: r["modified_idx"] for r in consistency.map_trial_answers(table).collect()}
    assert got == {1: 2, 2: 1, 3: -1, 4: -1}


@pytest.mark.parametrize(
    "answers, original, correct, score, flag",
    [([0, 0, 0, 1, 2], 0, 0, 0.4, True), ([1, 1, 1, 1, 1], 0, 3, 0.0, False), ([], 0, 0, 1.0, True)],
)
def test_consistency_verdict(spark, answers, original, correct, score, flag):
    mapped = spark.createDataFrame([(1, a) for a in answers], "item_id bigint, modified_idx int")
    originals = spark.createDataFrame(
        [(1, original, correct)], "item_id bigint, original_idx int, correct_idx int"
    )
    row = consistency.consistency_verdict(consistency.consistency_score(mapped, originals)).first()
    assert row["memorization_score"] == pytest.approx(score) and row["is_memorized"] is flag


DETECTIONS = "item_id bigint, method string, memorization_score double, is_memorized boolean, error string"


def test_aggregate_takes_half_and_skips_failures(spark):
    found = spark.createDataFrame(
        [
            (1, "a", 0.2, True, None),
            (1, "b", 0.6, False, None),
            (2, "a", None, None, "x"),
            (2, "b", 0.5, False, None),
            (3, "a", None, None, "x"),
        ],
        DETECTIONS,
    )
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id bigint")
    rows = {r["item_id"]: (r["aggregate_score"], r["is_memorized"]) for r in verdict.aggregate_verdict(items, found).collect()}
    assert rows == {1: (0.4, True), 2: (0.5, False), 3: (0.0, False)}


def test_missing_detections_become_errors(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id bigint")
    found = spark.createDataFrame([(1, "a", 0.2, True, None)], DETECTIONS).withColumn("threshold", F.lit(0.3))
    rows = verdict.complete_detections(items, found, ["a"]).collect()
    assert {r["item_id"]: r["error"] for r in rows} == {1: None, 2: "no result"}


def test_only_chosen_methods_are_built():
    def fail():
        raise AssertionError("not chosen")

    with pytest.raises(ValueError):
        verdict.run_methods({"a": fail}, ["b"])


def test_histogram_has_all_bins(spark):
    scores = spark.createDataFrame([(float(i),) for i in range(11)] + [(0.0,)], "aggregate_score double")
    rows = sorted(verdict.score_histogram(scores).collect())
    assert [r["items"] for r in rows] == [2, 1, 1, 1, 1, 1, 1, 1, 1, 2]
    same = spark.createDataFrame([(1.0,)], "aggregate_score double")
    assert {r["bin"]: r["items"] for r in verdict.score_histogram(same).collect()}[5] == 1


def test_embedding_verdict_without_references_is_zero(spark):
    table = spark.createDataFrame([(1, None), (2, 0.9), (2, 0.1)], "item_id bigint, similarity double")
    rows = {r["item_id"]: (r["memorization_score"], r["is_memorized"]) for r in embeddings.embedding_verdict(table).collect()}
    assert rows == {1: (0.0, False), 2: (0.9, True)}


def test_entity_scores_and_rarity(spark):
    listed = spark.createDataFrame([("Paris",), ("New York",), ("Oz",)], "entity string")
    corpus = spark.createDataFrame(
        [(1, "Paris, Paris and New York!"), (2, "Parisian New  York"), (3, "bronze ozone")],
        "doc_id bigint, text string",
    )
    rows = {r["entity"]: r["occurrences"] for r in entities.entity_rarity(listed, corpus, "text").collect()}
    assert rows == {"Paris": 2, "New York": 1, "Oz": 0}
    named = entities.texts_with_entities(corpus, listed, "doc_id", "text")
    assert sorted(r["doc_id"] for r in named.collect()) == [1, 2]
    only = spark.createDataFrame([("New York",)], "entity string")
    assert [r["doc_id"] for r in entities.texts_with_entities(corpus, only, "doc_id", "text").collect()] == [1]


def test_entity_hits_ignore_case(spark):
    completions = spark.createDataFrame(
        [("Oz", "The capital of {entity} is", "the EMERALD city"), ("Oz", "{entity} is located in", "x")],
        "entity string, template string, completion string",
    )
    truth = spark.createDataFrame([("Oz", "The capital of", "Emerald")], "entity string, key string, expected string")
    hits = entities.entity_hits(completions, truth)
    assert sorted(r["is_correct"] for r in hits.collect()) == [False, True]
    listed = spark.createDataFrame([("Oz",), ("Ur",)], "entity string")
    rows = {r["entity"]: r["score"] for r in entities.entity_score(hits, listed).collect()}
    assert rows == {"Oz": 0.5, "Ur": 0.0}


@pytest.mark.parametrize(
    "predicted, actual, expected",
    [("12", "120", True), (" A ", "a", True), ("x", "y", False), ("", "y", False), (None, "y", False)],
)
def test_fuzzy_match(spark, predicted, actual, expected):
    row = spark.createDataFrame([(predicted, actual)], "p string, a string")
    assert row.select(tabular.fuzzy_match(F.col("p"), F.col("a"))).first()[0] is expected


def test_row_values_and_accuracy(spark):
    completions = spark.createDataFrame([(1, "a: 5\nb:  x "), (2, "nothing")], "row_id bigint, completion string")
    extracted = tabular.extract_row_values(completions, ["a", "b", "c"])
    assert sorted((r["column"], r["predicted"]) for r in extracted.collect()) == [("a", "5"), ("b", "x")]
    table = spark.createDataFrame([(1, 5, "y", 0), (2, 1, "z", 0)], "k bigint, a int, b string, c int")
    actual = tabular.held_out_values(table, "k", ["a", "b", "c"])
    accuracy = tabular.row_accuracy(tabular.compare_rows(extracted, actual), completions)
    assert {r["row_id"]: r["accuracy"] for r in accuracy.collect()} == {1: 0.5, 2: 0.0}


def test_extraction_rates(spark):
    pairs = spark.createDataFrame(
        [(["a", "b"], ["a", "b", "c"]), (["a", "b"], ["a", "x"]), (["a", "b"], ["x"])],
        "e array<string>, p array<string>",
    )
    row = verdict.extraction_rates(pairs, F.col("e"), F.col("p")).first()
    assert row["exact_rate"] == pytest.approx(1 / 3) and row["fractional_rate"] == pytest.approx(0.5)


def test_threshold_sweep(spark):
    rows = [(0.9, 1), (0.4, 1), (0.8, 0), (0.1, 0)]
    swept = verdict.threshold_sweep(spark.createDataFrame(rows, "s double, y int"), "s", "y", [0.5])
    row = swept.first()
    assert (row["precision"], row["recall"]) == (0.5, 0.5)


def test_thresholds_may_differ_per_dataset(spark):
    scored = spark.createDataFrame([("a", 0.4), ("b", 0.4), ("c", 0.4)], "dataset string, score double")
    limits = spark.createDataFrame([("a", 0.3), ("b", 0.5)], "dataset string, threshold double")
    rows = {r["dataset"]: r["is_memorized"] for r in verdict.calibrated_verdict(scored, limits, "dataset", "score").collect()}
    assert rows == {"a": True, "b": False, "c": False}


def test_combined_confidence_counts_only_fired(spark):
    found = spark.createDataFrame(
        [(1, True, 0.6), (1, False, 0.9), (2, False, 0.9)], "item_id bigint, is_memorized boolean, confidence double"
    )
    rows = {r["item_id"]: (r["confidence"], r["is_memorized"]) for r in verdict.combined_confidence(found).collect()}
    assert rows == {1: (0.6, True), 2: (0.0, False)}


def test_details_follow_the_strongest_output(spark):
    scores = [(1, "a", "ngram", 0.2), (1, "b", "ngram", 0.5), (1, "c", "ngram", 0.5), (1, "d", "ngram", None), (2, "e", "ngram", None), (1, None, "perplexity", 1.0)]
    found = spark.createDataFrame(scores, "item_id bigint, response_id string, method string, memorization_score double")
    sizes = [(1, r, n, 4, n / 10) for r in "abc" for n in (3, 2)]
    by_size = spark.createDataFrame(sizes, "item_id bigint, response_id string, n int, references bigint, max_overlap_ratio double")
    options = [(1, 2, 0, -3.0), (1, 0, 0, -1.0), (1, 1, 0, -2.0), (3, 0, None, -1.0)]
    details = detail.method_details(
        {
            "ngram": detail.size_detail(by_size, ("response_id",)),
            "perplexity": detail.option_detail(spark.createDataFrame(options, "item_id bigint, option_idx int, correct_idx int, logprob double")),
        }
    )
    per_method = found.select("item_id", "method").distinct()
    rows = {(r["item_id"], r["method"]): r for r in detail.with_detail(per_method, found, details).collect()}
    assert rows[1, "ngram"]["shown"] == "c" and [s["n"] for s in rows[1, "ngram"]["detail"]["sizes"]] == [2, 3]
    assert rows[2, "ngram"]["shown"] is None and rows[2, "ngram"]["detail"] is None
    one = rows[1, "perplexity"]
    assert (one["shown"], one["detail"]["option_logprobs"], one["detail"]["baseline"]) == (None, [-1.0, -2.0, -3.0], -2.5)
    assert one["detail"]["sizes"] is None and len(rows) == 3
    assert detail.with_detail(per_method.limit(0), found.limit(0), details.limit(0)).collect() == []


def test_membership_separates_clear_classes(spark):
    rows = [(i, float(i), 1 if i > 20 else 0) for i in range(40)] + [(99, 39.0, None)]
    table = spark.createDataFrame(rows, "id bigint, f double, y int")
    got = {r["id"]: r for r in membership_scores(table, "id", ["f"], "y").collect()}
    assert len(got) == 41 and got[99]["y"] is None
    assert got[39]["membership"] > 0.9 > 0.1 > got[0]["membership"]


def test_membership_against_the_minimum_of_its_loss(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1.0, 40.0] + [5.0, -20.0]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 5) * 2 + (x[:, 1] + 20) / 40))).astype(int)
    rows = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    table = spark.createDataFrame(rows, "id int, a double, b double, y int")
    got = {r["id"]: r["membership"] for r in membership_scores(table, "id", ["a", "b"], "y").collect()}
    z = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)])
    weights = np.zeros(3)
    for _ in range(20_000):
        weights += 0.005 * (z.T @ (y - 1 / (1 + np.exp(-z @ weights))) - weights)
    assert np.allclose([got[i] for i in range(300)], 1 / (1 + np.exp(-z @ weights)), atol=1e-6)


@pytest.mark.parametrize("labels, expected", [([1, 1, 1], 1), ([0, 0, 0], 0), ([None, None, None], 0)])
def test_membership_of_one_class_constants_and_gaps(spark, labels, expected):
    rows = [(i, None if i == 1 else 2.0, label) for i, label in enumerate(labels)]
    table = spark.createDataFrame(rows, "id int, f double, y int")
    got = membership_scores(table.select("*", F.lit(3.0).alias("flat")), "id", ["f", "flat"], "y").collect()
    assert [r["prediction"] for r in got] == [expected] * 3
    assert membership_scores(table.where("id > 9"), "id", ["f"], "y").collect() == []


def test_every_query_has_a_name_and_no_oracle_is_orphaned():
    from leakscope.plans.oracles import ORACLES

    assert set(ORACLES) == set(queries.QUERIES)


def test_entities_of_signs_and_several_words(spark):
    listed = spark.createDataFrame([("AT&T",), ("&&",), ("New York",), ("",)], "entity string")
    corpus = spark.createDataFrame(
        [(1, "AT&T, AT&T and New York"), (2, "a && b"), (3, "a&&&b New-York")], "doc_id bigint, text string"
    )
    rows = {r["entity"]: r["occurrences"] for r in entities.entity_rarity(listed, corpus, "text").collect()}
    assert rows["AT&T"] == 2 and rows["New York"] == 1
    named = entities.texts_with_entities(corpus, listed.where("entity = '&&'"), "doc_id", "text")
    assert sorted(r["doc_id"] for r in named.collect()) == [2, 3]


def test_entity_filter_against_brute_force(spark):
    import random

    rng = random.Random(4)
    syllables = ["an", "be", "co", "é", "x", "ta_", "9", "Ü"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    texts = [(i, rng.choice([" ", " - ", "&", "\n"]).join(["common", *(word() for _ in range(rng.randint(0, 12)))])) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "z" * 30_000), (903, "common&&beco")]
    names = ["common", "beco", "be - co", "a", "é", "&&", " - ", "", "coan be", "zz", "xé&", "absent words", "9Ü9Ü", "ta_ta_"]
    corpus = spark.createDataFrame(texts, "doc_id bigint, text string")
    for name in names:
        listed = spark.createDataFrame([(name,), (name,)], "entity string")
        found = entities.texts_with_entities(corpus, listed, "doc_id", "text")
        assert sorted(r.doc_id for r in found.collect()) == [i for i, t in texts if name and t and name in t], name
    some = names[1:4] + names[7:]
    found = entities.texts_with_entities(corpus, spark.createDataFrame([(n,) for n in some], "entity string"), "doc_id", "text")
    assert sorted(r.doc_id for r in found.collect()) == [i for i, t in texts if any(n and t and n in t for n in some)]


def test_occurrences_are_counted_for_listed_entities_only(spark):
    """Runs that are no entity are left out before they are counted and shuffled."""
    corpus = spark.createDataFrame([(i, f"Paris w{i} x{i} New York, y{i}") for i in range(400)], "doc_id int, text string")
    listed = spark.createDataFrame([("Paris",), ("New York",), ("Oz",), (None,)], "entity string")
    counted = entities.entity_occurrences(listed, corpus, "text")
    assert {r.entity: r.occurrences for r in counted.collect()} == {"Paris": 400, "New York": 400}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(entity" in plan[: plan.rindex("Generate")]


def test_entities_and_followers_are_found_once(spark, tmp_path):
    from leakscope.plans import inputs
    from leakscope.plans.frames import forget

    spark.createDataFrame([(1, "Paris Match Paris"), (2, "in Paris Match")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("ASIA",)], "r_name string").write.parquet(f"{tmp_path}/region.parquet")
    forget(spark)
    found, after = inputs.entities(spark, str(tmp_path)), inputs.followers(spark, str(tmp_path))
    forget(spark)
    assert sorted(r.entity for r in found.collect()) == ["ASIA", "Match", "Paris"]
    assert {r.entity: r.follower for r in after.collect()} == {"Paris": "Match", "Match": "Paris"}
    assert all("documents.parquet" not in f for f in [*found.inputFiles(), *after.inputFiles()])

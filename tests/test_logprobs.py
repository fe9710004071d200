import math

import pytest
from pyspark.sql import functions as F

from leakscope.functions.significance import two_sided_p
from leakscope.operators import corpus_lm, logprobs

ROW_1 = [-1.3862943611198906, -2.1972245773362196, -1.2809338454620642, -1.1526795099383855]
ROW_2 = [-1.410986973710262, -1.252762968495368, -1.9459101490553135, -1.2992829841302609]


@pytest.mark.parametrize(
    "values, baseline, score, flag",
    [
        (ROW_1, "all", 1.421344939, False),
        (ROW_1, "incorrect", 1.598083, True),
        (ROW_2, "all", 1.194768909, False),
        (ROW_2, "incorrect", 1.267784, False),
    ],
)
def test_option_perplexity_recorded_runs(spark, values, baseline, score, flag):
    rows = [(1, i, 3, v) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "item_id bigint, option_idx int, correct_idx int, logprob double")
    got = logprobs.option_perplexity(table, baseline=baseline).first()
    assert got["memorization_score"] == pytest.approx(score, abs=1e-6)
    assert got["is_memorized"] is flag


def test_option_perplexity_unknown_answer_is_an_error(spark):
    table = spark.createDataFrame(
        [(1, 0, None, -1.0)], "item_id bigint, option_idx int, correct_idx int, logprob double"
    )
    row = logprobs.option_perplexity(table).first()
    assert row["memorization_score"] is None and row["error"] == "correct option unknown"


TOKENS = "seq_id string, pos int, token string, logprob double, prompt_chars int, total_chars int"


def test_continuation_logprob_boundary(spark):
    rows = [
        ("s", 0, "Hello", None, 5, 11),
        ("s", 1, " wor", -1.0, 5, 11),
        ("s", 2, "ld", -2.0, 5, 11),
        ("s", 3, "!", -3.0, 5, 12),
    ]
    rows = [r[:5] + (12,) for r in rows]
    table = spark.createDataFrame(rows, TOKENS)
    assert logprobs.continuation_logprob(table, "seq_id").first()["logprob"] == pytest.approx(-2.0)
    late = logprobs.continuation_logprob(table, "seq_id", skip_null_length=True).first()
    assert late["logprob"] == pytest.approx(-2.5)


def test_continuation_logprob_leaves_out_generated_tokens(spark):
    rows = [("s", 0, "ab", -1.0, 1, 2), ("s", 1, "generated", -9.0, 1, 2)]
    row = logprobs.continuation_logprob(spark.createDataFrame(rows, TOKENS), "seq_id").first()
    assert (row["logprob"], row["token_count"]) == (-1.0, 1)


def test_sequence_perplexity(spark):
    table = spark.createDataFrame(
        [("a", -0.24138194, 2), ("b", None, 2)], "seq_id string, logprob double, text_tokens int"
    )
    rows = {r["seq_id"]: r for r in logprobs.sequence_perplexity(table, "seq_id").collect()}
    assert rows["a"]["perplexity"] == pytest.approx(1.273007155, abs=1e-9)
    assert rows["b"]["avg_logprob"] == 0.0 and math.isinf(rows["b"]["perplexity"])
    divided = logprobs.sequence_perplexity(
        table, "seq_id", denominator="text_tokens", text_tokens="text_tokens"
    )
    assert divided.where("seq_id = 'a'").first()["avg_logprob"] == pytest.approx(-0.12069097)


def test_last_prefix_equals_the_sequence(spark):
    rows = [("s", i, f"t{i}", None if i == 0 else -0.1 * i) for i in range(9)]
    table = spark.createDataFrame(rows, "seq_id string, pos int, token string, logprob double")
    last = logprobs.progressive_perplexity(table, "seq_id", with_prefix=True).where("pos = 8").first()
    whole = logprobs.sequence_perplexity(table, "seq_id").first()
    assert last["perplexity"] == pytest.approx(whole["perplexity"])
    assert last["prefix_text"] == "".join(f"t{i}" for i in range(9))


def test_recorded_contrast(spark):
    known = [1.2730071548207884, 2.246274576095954, 1.0684706692472836]
    random = [1.0015565387508398, 1.8656553771019884, 3.5622006001504314]
    rows = [("known", p) for p in known] + [("random", p) for p in random]
    got = logprobs.perplexity_contrast(spark.createDataFrame(rows, "category string, perplexity double")).first()
    assert got["contrast_ratio"] == pytest.approx(1.401430, abs=1e-6)
    assert got["random_max"] == pytest.approx(3.562201, abs=1e-6)


def test_ratio_verdict_uses_absolute_or_relative_perplexity(spark):
    scored = spark.createDataFrame([("a", 4.0)], "text_id string, perplexity double")
    alone = logprobs.ratio_verdict(scored).first()
    assert alone["is_memorized"] and alone["confidence"] == pytest.approx(0.6)
    references = spark.createDataFrame([(0.5,)], "perplexity double")
    assert not logprobs.ratio_verdict(scored, references).first()["is_memorized"]


def test_nucleus_keeps_until_the_mass_is_reached(spark):
    top = [(f"t{i}", math.log(p)) for i, p in enumerate([0.2, 0.5, 0.3])]
    table = spark.createDataFrame(
        [("s", 0, top), ("s", 1, [])],
        "id string, pos int, top_logprobs array<struct<token: string, logprob: double>>",
    )
    kept = logprobs.temperature_top_p(table, "id", 1.0, 0.8).orderBy("rank").collect()
    assert [r["alternative"] for r in kept] == ["t1", "t2"]
    assert [r["nucleus_probability"] for r in kept] == pytest.approx([0.625, 0.375])


def test_option_logprob_sources(spark):
    table = spark.createDataFrame(
        [(-1.0, -2.0), (None, -2.0), (None, None)], "logprob double, sim_logprob double"
    )
    got = [(r["source"], r["logprob"]) for r in logprobs.option_logprobs(table).collect()]
    assert got == [("logprob", -1.0), ("similarity", -2.0), ("default", -10.0)]


def test_similarity_logprob_has_a_floor(spark):
    table = spark.createDataFrame([("abc", "ABC"), ("abc", "xyz")], "a string, b string")
    got = [r["s"] for r in logprobs.similarity_logprob(table, "a", "b", "s").collect()]
    assert got == pytest.approx([0.0, math.log(0.01)])


def test_rule_logprobs_by_literal_tokens(spark):
    """One rule ignores case, the three classes take the trimmed token as it is written."""
    table = spark.createDataFrame([("The",), (" the",), (" ",), ("Paris",), ("xyz",), ("paris",), ("\nParis ",), ("THE",)], "t string")
    got = table.select(
        corpus_lm.rule_logprob(F.col("t")), corpus_lm.rule_logprob_by_class(F.col("t"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (-1.0, -4.75), (-2.0, -1.5), (-1.0, -4.75), (-2.0, -2.75), (-2.0, -4.75), (-2.0, -4.75), (-2.0, -2.75), (-1.0, -4.75)
    ]


def brute_logprob(corpus, prev, token):
    words = [text.split() for text in corpus]
    flat = [w for text in words for w in text]
    pairs = [p for text in words for p in zip(text, text[1:])]
    return math.log((pairs.count((prev, token)) + 1) / (flat.count(prev) + len(set(flat))))


def test_bigram_model_against_brute_force(spark):
    corpus = ["a b a b a", "b c"] * 3 + ["d"]
    scored = ["a b x", "q a", "c"]
    docs = spark.createDataFrame([(t,) for t in corpus], "text string")
    rows = corpus_lm.text_token_rows(
        spark.createDataFrame(list(enumerate(scored)), "id int, text string"), "id", "text"
    )
    for r in corpus_lm.score_tokens(rows, docs, "text", "id").collect():
        if r["prev"] is None:
            assert r["logprob"] is None
        else:
            assert r["logprob"] == pytest.approx(brute_logprob(corpus, r["prev"], r["token"]))
    both = [(t, True) for t in corpus] + [(t, False) for t in scored]
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(both)], "id int, text string, m boolean")
    tagged = table.withColumn("key", F.struct("id", F.col("m").alias("in_model")))
    own = corpus_lm.text_token_rows(tagged, "key", "text").select("key.*", "pos", "prev", "token")
    got = corpus_lm.score_own_tokens(own, "id", "in_model").where("prev is not null").collect()
    assert len(got) == sum(max(len(t.split()) - 1, 0) for t, _ in both)
    for r in got:
        assert r["logprob"] == pytest.approx(brute_logprob(corpus, r["prev"], r["token"]))


def _long_tail(rng):
    """Texts with hot words, a hot pair and thousands of rare words, some of rows without a word."""
    word = lambda: f"w{int(rng.random() ** 3 * 4000)}" if rng.random() < 0.6 else rng.choice(["the", "of", "a"])
    return [" ".join("of the" if rng.random() < 0.1 else word() for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_bigram_model_with_rare_and_hot_words_against_brute_force(spark):
    """Rows are scored without a table of all pairs, and the corpus pass keeps the pairs that are asked for."""
    import random
    from collections import Counter

    rng = random.Random(5)
    texts = [(i, t, i % 3 > 0) for i, t in enumerate(_long_tail(rng))]
    corpus = [t.split() for _, t, m in texts if m]
    words, pairs = Counter(w for t in corpus for w in t), Counter(p for t in corpus for p in zip(t, t[1:]))
    brute = lambda p: math.log((pairs[p] + 1) / (words[p[0]] + len(words)))
    table = spark.createDataFrame(texts, "id int, text string, m boolean").repartition(4)
    key = F.struct("id", F.col("m").alias("in_model")).alias("key")
    own = corpus_lm.token_rows(table.select(key, "text"), "key", corpus_lm.word_tokens(F.col("text"))).select("key.*", "pos", "prev", "token")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corpus_lm.score_own_tokens(own, "id", "in_model")
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("leakscope-pair-counts" in f for f in found.inputFiles())
    assert len(got) == sum(len(t.split()) for _, t, _ in texts)
    for r in got:
        assert r.logprob == (None if r.prev is None else pytest.approx(brute((r.prev, r.token))))
    asked = corpus_lm.text_token_rows(table.where("NOT m AND id < 12"), "id", "text")
    scored = corpus_lm.score_tokens(asked, table.where("m"), "text", "id")
    for r in scored.collect():
        assert r.logprob == (None if r.prev is None else pytest.approx(brute((r.prev, r.token))))
    folder = next(f for f in scored.inputFiles() if "leakscope-pair-counts" in f).rsplit("/", 1)[0]
    kept = spark.read.parquet(folder).where("prev IS NOT NULL").count()
    assert 0 < kept <= asked.select("prev", "token").distinct().count() < len(pairs) / 4


def scored(spark, rows):
    columns = "text_id string, category string, avg_logprob double, token_count int, is_infinite boolean, perplexity double"
    return spark.createDataFrame([(i, c, -math.log(p) if p else 0.0, 3, p is None, p or math.inf) for i, c, p in rows], columns)


def test_infinite_texts_stay(spark):
    table = scored(spark, [("a", "known", 2.0), ("b", "known", None), ("c", "random", 4.0), ("d", "random", 8.0)])
    summary = logprobs.compare_perplexities(table, "text_id").first()
    assert (summary.texts, summary.infinite, summary.lowest_id, summary.highest_id) == (4, 1, "a", "b")
    assert summary.avg_perplexity == pytest.approx(14 / 3)
    assert [r.text_id for r in logprobs.rank_by_perplexity(table, "text_id").collect()] == ["a", "c", "d", "b"]
    contrast = logprobs.perplexity_contrast(table).first()
    assert (contrast.known_avg, contrast.known_infinite, contrast.contrast_ratio) == (2.0, 1, 3.0)
    by = {r.category: (r.texts, r.infinite, r.avg_perplexity) for r in logprobs.perplexity_by_category(table).collect()}
    assert by == {"known": (2, 1, 2.0), "random": (2, 0, 6.0)}
    judged = {r.text_id: r.is_memorized for r in logprobs.ratio_verdict(table, threshold=5.0).collect()}
    assert judged == {"a": True, "b": False, "c": True, "d": False}
    outliers = {r.text_id: (r.z_score, r.is_outlier) for r in logprobs.perplexity_outliers(table, "random").collect()}
    assert outliers["b"] == (None, False) and len(outliers) == 4


def test_significance_of_classes_that_do_not_vary(spark):
    table = scored(spark, [("a", "x", 2.0), ("b", "x", 2.0), ("c", "y", 4.0), ("d", "y", 4.0), ("e", "y", None)])
    r = logprobs.contrast_significance(table, "x", "y").first()
    assert (r.n_left, r.n_right, r.infinite_right, r.t_value, r.degrees, r.p_value) == (2, 2, 1, None, None, None)


def _tail(t, degrees):
    """Two-sided p by Simpson's rule over the density, from 0 to t."""
    front = math.exp(math.lgamma((degrees + 1) / 2) - math.lgamma(degrees / 2)) / math.sqrt(degrees * math.pi)
    steps = 20_000
    inside = sum(
        (1 if i in (0, steps) else 4 if i % 2 else 2) * math.exp(-(degrees + 1) / 2 * math.log1p((t * i / steps) ** 2 / degrees))
        for i in range(steps + 1)
    )
    return 1 - 2 * front * inside * abs(t) / (3 * steps)


def test_two_sided_p(spark):
    rows = [(t, n) for t in (0.0, 1e-6, -0.3, 1.0, 1.7, -1.8, 2.5, 6.0, 20.0) for n in (1.0, 1.5, 2.0, 3.3, 10.0, 97.4, 1e4, 1e6)]
    table = spark.createDataFrame([*rows, (None, 3.0), (1.0, None)], "t double, n double")
    found = table.select("t", "n", two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()
    for r in found:
        if r.t is None or r.n is None:
            assert r.p is None
        else:
            assert 0 <= r.p <= 1 and abs(r.p - _tail(r.t, r.n)) < 1e-7, (r.t, r.n, r.p)
    exact = {(1.0, 1.0): 0.5, (1.0, 2.0): 1 - math.sqrt(1 / 3), (0.0, 10.0): 1.0}
    assert all(abs(r.p - exact[r.t, r.n]) < 1e-12 for r in found if (r.t, r.n) in exact)
    for degrees, error in ((1e9, 1e-8), (1e12, 1e-6)):
        far = spark.range(1).select(two_sided_p(F.lit(1.959963984540054), F.lit(degrees)).alias("p")).first().p
        assert abs(far - 0.05) < error


def test_temperature_zero_keeps_the_likeliest(spark):
    table = spark.createDataFrame(
        [("s", 0, [("a", -1.0), ("b", -0.5), ("c", -0.5)]), ("s", 1, None)],
        "id string, pos int, top_logprobs array<struct<token: string, logprob: double>>",
    )
    kept = logprobs.temperature_top_p(table, "id", 0.0, 0.9).collect()
    assert [(r.alternative, r.probability, r.nucleus_probability) for r in kept] == [("b", 1.0, 1.0)]

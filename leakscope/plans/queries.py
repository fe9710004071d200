"""Registered queries: each operator over whole given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import text as fx
from leakscope.operators import (
    consistency,
    contamination,
    corpus_lm,
    dedup,
    detail,
    embeddings,
    entities,
    logprobs,
    membership,
    ngrams,
    prompts,
    tabular,
    verdict,
)
from leakscope.plans import inputs
from leakscope.session import shared_folder, stored
from leakscope.sources import questions, responses, results
from leakscope.plans.frames import forget, planned_once, read_table
from leakscope.sources.tables import read_tabular

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MODEL = "example-model"
VECTOR_THRESHOLD = 0.35
METHODS = ["perplexity", "ngram", "embedding", "consistency"]
# What tells the outputs of an item apart.
OUTPUT = ("response_id",)
SWEEP = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05]


def query(function: Query) -> Query:
    @functools.wraps(function)
    def called(spark: SparkSession, sf: str) -> DataFrame:
        forget(spark)
        return function(spark, sf)

    QUERIES[function.__name__] = called
    return function


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; negative zero becomes zero."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits) + F.lit(0.0)


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def _named(flag: str) -> Column:
    """A flag as text, 'none' where a detector failed."""
    return F.coalesce(F.col(flag).cast("string"), F.lit("none")).alias(flag)


# --- sources and sinks -------------------------------------------------------


@query
def load_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Records written by split and read back for one of them."""
    path = shared_folder(spark, "questions")
    inputs.raw_questions(spark, sf).write.partitionBy("split").json(path)
    records = questions.read_questions(spark, path, "train", "json")
    return records.select("id", "question", F.col("options.B").alias("option_b"), "answer", "split")


@query
def preprocess_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = questions.preprocess_questions(inputs.raw_questions(spark, sf))
    return rows.select(
        "id",
        "question",
        F.array_join("options", " | ").alias("options"),
        "formatted_prompt",
        "correct_answer",
        big(F.coalesce("correct_idx", F.lit(-1))).alias("correct_idx"),
    )


@planned_once
def _items_with_records(spark: SparkSession, sf: str) -> DataFrame:
    items = inputs.mcq(spark, sf)
    return items.select(
        "item_id",
        F.concat(F.lit("q"), F.col("item_id")).alias("id"),
        "question",
        "options",
        F.col("continuation").alias("correct_answer"),
    )


@planned_once
def _stored_detections(spark: SparkSession, sf: str) -> DataFrame:
    return stored(detections(spark, sf), "detections")


@planned_once
def _documents_of_run(spark: SparkSession, sf: str) -> DataFrame:
    per_method = stored(verdict.method_verdicts(_stored_detections(spark, sf)), "method-verdicts")
    verdicts = verdict.aggregate_verdict(inputs.mcq(spark, sf), per_method)
    detailed = detail.with_detail(per_method, _stored_detections(spark, sf), _stored_details(spark, sf))
    return results.result_documents(_items_with_records(spark, sf), detailed, verdicts)


@planned_once
def _stored_details(spark: SparkSession, sf: str) -> DataFrame:
    by_size = ngrams.ngram_by_size(_overlaps(spark, sf), OUTPUT)
    parts = {
        "perplexity": detail.option_detail(inputs.option_scores(spark, sf)),
        "ngram": detail.size_detail(by_size, OUTPUT),
        "embedding": detail.similarity_detail(inputs.vector_similarities(spark, sf)),
        "consistency": detail.trial_detail(_mapped(spark, sf)),
    }
    return stored(detail.method_details(parts), "method-details")


def _detail_columns() -> list[Column]:
    """A detail as numbers: how many entries, their total, the baseline, the trials' letters."""
    one = F.col("detail")
    values = F.coalesce(
        one["option_logprobs"],
        one["sizes"]["max_overlap_ratio"],
        one["similarities"],
        F.transform(one["trials"]["modified_idx"], lambda i: i.cast("double")),
    )
    total = F.aggregate(values, F.lit(0.0), lambda total, value: total + value)
    return [
        F.when(one.isNotNull(), big(F.size(values))).alias("detail_entries"),
        r(total).alias("detail_total"),
        r(one["baseline"]).alias("detail_baseline"),
        F.array_join(one["trials"]["modified_answer"], ",").alias("detail_answers"),
        "shown",
    ]


@query
def result_documents(spark: SparkSession, sf: str) -> DataFrame:
    return results.flatten_documents(_documents_of_run(spark, sf)).select(
        "id",
        "method",
        r("memorization_score").alias("memorization_score"),
        _named("is_memorized"),
        "error",
        "outputs",
        "failed",
        *_detail_columns(),
        r("aggregate_score").alias("aggregate_score"),
        "verdict",
    )


@query
def results_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "run")
    documents = _documents_of_run(spark, sf)
    metadata = results.run_metadata(
        inputs.mcq(spark, sf), MODEL, "train", METHODS, "2026-01-01T00:00:00"
    )
    results.write_run(documents, metadata, path)
    results.write_detections(_stored_detections(spark, sf), path)
    results.write_details(_stored_details(spark, sf), path)
    kept = results.read_details(spark, path).groupBy("item_id", "method").agg(F.count("*").alias("kept_details"))
    again = verdict.method_verdicts(results.read_detections(spark, path)).select(
        F.concat(F.lit("q"), F.col("item_id")).alias("id"), "method", F.col("memorization_score").alias("rescored")
    )
    kept = kept.select(F.concat(F.lit("q"), F.col("item_id")).alias("id"), "method", "kept_details")
    back = results.flatten_documents(results.read_run(spark, path)).join(again, ["id", "method"], "left").join(
        kept, ["id", "method"], "left"
    )
    run = results.read_metadata(spark, path).select(F.struct("model", "num_examples", F.size("methods").alias("n"))).scalar()
    return back.withColumn("_run", run).select(
        "id",
        "method",
        r("memorization_score").alias("memorization_score"),
        r("rescored").alias("rescored"),
        _named("is_memorized"),
        r("aggregate_score").alias("aggregate_score"),
        "verdict",
        "threshold",
        "outputs",
        "failed",
        *_detail_columns(),
        "kept_details",
        F.col("_run.model").alias("model"),
        F.col("_run.num_examples").alias("num_examples"),
        big("_run.n").alias("n_methods"),
    )


@query
def chat_logprob_requests(spark: SparkSession, sf: str) -> DataFrame:
    items = inputs.mcq(spark, sf).select("item_id", "question", F.posexplode("options").alias("part", "option"))
    body = prompts.chat_logprob_body(MODEL, F.concat("question", "option"))
    return items.select("item_id", big("part").alias("part"), body.alias("body"))


@query
def request_table(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.request_table(inputs.mcq(spark, sf), MODEL).select(
        "item_id", "method", big("part").alias("part"), "body"
    )


@query
def parse_completions(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.completions(spark, sf).select("item_id", "response_id", "completion", "error")


@query
def parse_logprobs_legacy(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_legacy(inputs.legacy_bodies(spark, sf))
    return responses.legacy_token_rows(parsed, "response_id").select(
        "response_id", big("pos").alias("pos"), "token", "logprob"
    )


@query
def parse_logprobs_chat(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_chat(inputs.chat_bodies(spark, sf))
    return responses.chat_token_rows(parsed, "response_id").select(
        "response_id",
        big("pos").alias("pos"),
        "token",
        "logprob",
        big(F.size("top_logprobs")).alias("alternatives"),
    )


@query
def response_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_legacy(inputs.legacy_bodies(spark, sf))
    return responses.quarantined(parsed).select("response_id", "error")


# --- projections, filters, sampling, prompts ---------------------------------


@query
def format_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt = prompts.multiple_choice_prompt(F.col("question"), F.col("options"))
    return inputs.mcq(spark, sf).select("item_id", prompt.alias("prompt"))


@query
def method_prompts(spark: SparkSession, sf: str) -> DataFrame:
    question, options = F.col("question"), F.col("options")
    return inputs.mcq(spark, sf).select(
        "item_id",
        prompts.explanation_prompt(question, options).alias("explanation_prompt"),
        prompts.stepwise_prompt(question, options).alias("stepwise_prompt"),
    )


def _modified(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return prompts.trial_plan(inputs.mcq(spark, sf), types=(kind,)).select(
        "item_id",
        big("trial").alias("trial"),
        F.array_join("options_shown", " | ").alias("options_shown"),
        "prompt",
    )


@query
def prompt_reordered(spark: SparkSession, sf: str) -> DataFrame:
    return _modified(spark, sf, "reordered")


@query
def prompt_rephrased(spark: SparkSession, sf: str) -> DataFrame:
    return _modified(spark, sf, "rephrased")


@query
def prompt_both(spark: SparkSession, sf: str) -> DataFrame:
    return _modified(spark, sf, "both")


@query
def answer_index(spark: SparkSession, sf: str) -> DataFrame:
    raw = inputs.raw_questions(spark, sf).withColumn(
        "options", questions.option_array(F.col("options"))
    )
    return questions.answer_index(raw, "options", "answer", "answer_idx").select(
        "id", big("answer_idx").alias("answer_idx")
    )


@query
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return questions.seeded_sample(documents, 100, "doc_id", seed=42)


@query
def selected_methods(spark: SparkSession, sf: str) -> DataFrame:
    found = verdict.run_methods(detectors(spark, sf), ["ngram", "consistency"])
    return found.groupBy("method").agg(
        F.count_distinct("item_id").alias("items"),
        F.count("*").alias("outputs"),
        F.count("memorization_score").alias("scored"),
        F.count_if("is_memorized").alias("memorized"),
    )


@query
def detection_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Also the items that a method gave no result for."""
    every = verdict.complete_detections(inputs.mcq(spark, sf), detections(spark, sf), METHODS)
    return verdict.detection_errors(every)


@query
def text_preview(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(
        "doc_id", fx.preview(F.col("text")).alias("preview")
    )


# --- n-grams -----------------------------------------------------------------


@query
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = read_table(spark, sf, "documents").select(
        "doc_id", fx.word_tokens(F.col("text")).alias("w")
    )
    return tokens.select(
        "doc_id",
        big(F.size("w")).alias("tokens"),
        big(F.size(F.array_distinct("w"))).alias("distinct_tokens"),
        F.md5(F.array_join("w", " ")).alias("digest"),
    )


@query
def ngram_sets(spark: SparkSession, sf: str) -> DataFrame:
    tokens = read_table(spark, sf, "documents").select(
        "doc_id", fx.word_tokens(F.col("text")).alias("w")
    )
    sizes = [big(F.size(fx.ngram_set(F.col("w"), n))).alias(f"grams_{n}") for n in (2, 3, 4)]
    return tokens.select("doc_id", *sizes)


@planned_once
def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    usable = inputs.completions(spark, sf).where(F.col("error").isNull())
    return ngrams.ngram_overlap(usable, ngrams.own_references(inputs.mcq(spark, sf)), keys=OUTPUT)


@query
def ngram_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).select(
        "item_id",
        "response_id",
        big("ref_idx").alias("ref_idx"),
        big("n").alias("n"),
        big("overlap_count").alias("overlap_count"),
        big("ref_count").alias("ref_count"),
        r("overlap_ratio").alias("overlap_ratio"),
    )


@query
def ngram_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.ngram_by_size(_overlaps(spark, sf), OUTPUT).select(
        "item_id",
        "response_id",
        big("n").alias("n"),
        big("output_count").alias("output_count"),
        "references",
        r("max_overlap_ratio").alias("max_overlap_ratio"),
    )


@planned_once
def _ngram_detections(spark: SparkSession, sf: str) -> DataFrame:
    scored = ngrams.ngram_verdict(ngrams.ngram_by_size(_overlaps(spark, sf), OUTPUT), keys=OUTPUT)
    errors = inputs.completions(spark, sf).select("item_id", "response_id", "error")
    return errors.join(scored, ["item_id", "response_id"], "left")


@query
def ngram_verdict(spark: SparkSession, sf: str) -> DataFrame:
    scored = ngrams.ngram_verdict(ngrams.ngram_by_size(_overlaps(spark, sf), OUTPUT), keys=OUTPUT)
    return scored.select("item_id", "response_id", r("memorization_score").alias("memorization_score"), "is_memorized")


@planned_once
def _contaminated(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.corpus_contamination(
        read_table(spark, sf, "benchmark"), read_table(spark, sf, "documents")
    )


@query
def corpus_contamination(spark: SparkSession, sf: str) -> DataFrame:
    return _contaminated(spark, sf).select(
        "item_id",
        "doc_id",
        big("overlap_count").alias("overlap_count"),
        big("ref_count").alias("ref_count"),
        r("containment").alias("containment"),
    )


@query
def weighted_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.weighted_jaccard(inputs.dialogue_pairs(spark, sf), "reply", "question", "similarity")
    return pairs.select("conv_id", "turn", r("similarity").alias("similarity"))


@query
def prefix_probe(spark: SparkSession, sf: str) -> DataFrame:
    probes = prompts.prefix_probes(read_table(spark, sf, "documents"), "doc_id", "text")
    answered = probes.join(inputs.probe_completions(spark, sf), ["doc_id", "variant"])
    scored = fx.weighted_jaccard(answered, "completion", "truth", "similarity")
    return scored.select(
        "doc_id",
        big("variant").alias("variant"),
        F.md5("prompt").alias("prompt_digest"),
        r("similarity").alias("similarity"),
    )


# --- log-probabilities and perplexity ----------------------------------------


@planned_once
def _reply_tokens(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_legacy(inputs.legacy_bodies(spark, sf))
    return responses.legacy_token_rows(parsed, "response_id", "prompt_chars", "total_chars")


@query
def continuation_logprob(spark: SparkSession, sf: str) -> DataFrame:
    return logprobs.continuation_logprob(_reply_tokens(spark, sf), "response_id").select(
        "response_id", r("logprob").alias("logprob"), "token_count"
    )


@planned_once
def _output_similarities(spark: SparkSession, sf: str) -> DataFrame:
    usable = inputs.completions(spark, sf).where(F.col("error").isNull())
    options = inputs.mcq(spark, sf).select("item_id", F.posexplode("options").alias("option_idx", "option"))
    return logprobs.output_similarities(options, usable, OUTPUT)


@query
def similarity_logprob(spark: SparkSession, sf: str) -> DataFrame:
    scored = _output_similarities(spark, sf)
    return scored.select(
        "item_id", "response_id", "option_idx", r(logprobs.floored_log(F.col("similarity"))).alias("sim_logprob")
    )


@query
def option_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    """Scores come from the model, else from the most similar output, else from the default."""
    options = inputs.mcq(spark, sf).select(
        "item_id", F.posexplode("options").alias("option_idx", "option")
    )
    kind = inputs.pick(3, F.col("item_id"), "path")
    scores = inputs.option_scores(spark, sf).select("item_id", "option_idx", "logprob")
    best = _output_similarities(spark, sf).groupBy("item_id", "option_idx").agg(F.max("similarity").alias("best"))
    joined = options.join(scores, ["item_id", "option_idx"], "left").join(best, ["item_id", "option_idx"], "left")
    supplied = joined.withColumns(
        {"logprob": F.when(kind > 0, F.col("logprob")), "sim_logprob": logprobs.floored_log(F.col("best"))}
    )
    return logprobs.option_logprobs(supplied).select(
        "item_id", "option_idx", r("logprob").alias("logprob"), "source"
    )


@query
def option_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    scored = logprobs.option_perplexity(inputs.option_scores(spark, sf))
    return scored.select(
        "item_id",
        r("correct_logprob").alias("correct_logprob"),
        r("other_logprob").alias("other_logprob"),
        r("memorization_score").alias("memorization_score"),
        "is_memorized",
    )


def _perplexity_columns(key: str) -> list:
    return [
        key,
        r("avg_logprob").alias("avg_logprob"),
        "token_count",
        "valid_count",
        "is_infinite",
        F.when(~F.col("is_infinite"), r("perplexity", 4)).alias("perplexity"),
    ]


@query
def sequence_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_legacy(inputs.legacy_bodies(spark, sf))
    tokens = responses.legacy_token_rows(parsed, "response_id")
    return logprobs.sequence_perplexity(tokens, "response_id").select(
        *_perplexity_columns("response_id")
    )


@query
def rule_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    pieces = inputs.replies(spark, sf).select("response_id", F.posexplode("pieces").alias("pos", "token"))
    return pieces.select(
        "response_id",
        big("pos").alias("pos"),
        corpus_lm.rule_logprob(F.col("token")).alias("logprob"),
        corpus_lm.rule_logprob_by_class(F.col("token")).alias("class_logprob"),
    )


@query
def progressive_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_legacy(inputs.legacy_bodies(spark, sf))
    tokens = responses.legacy_token_rows(parsed, "response_id")
    return logprobs.progressive_perplexity(tokens, "response_id").select(
        "response_id",
        big("pos").alias("pos"),
        big("token_count").alias("token_count"),
        r("avg_logprob").alias("avg_logprob"),
        F.when(~F.col("is_infinite"), r("perplexity")).alias("perplexity"),
    )


@query
def compare_perplexities(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.scored_texts(spark, sf)
    rounded = scored.withColumn("perplexity", r("perplexity", 4))
    highest = F.col("highest_perplexity")
    return logprobs.compare_perplexities(rounded, "text_id").withColumns(
        {
            "avg_perplexity": r("avg_perplexity", 3),
            "highest_perplexity": F.when(highest < float("inf"), highest),
        }
    )


@query
def rank_by_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.scored_texts(spark, sf, "known", "random")
    return logprobs.rank_by_perplexity(scored, "text_id").select(
        "text_id",
        "category",
        r(logprobs.finite("perplexity"), 4).alias("perplexity"),
        "token_count",
        "is_infinite",
    )


@query
def perplexity_contrast(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.scored_texts(spark, sf, "known", "random")
    contrast = logprobs.perplexity_contrast(scored)
    return contrast.select(*[c if c.endswith("infinite") else r(c, 3).alias(c) for c in contrast.columns])


@query
def perplexity_by_category(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.scored_texts(spark, sf)
    named = scored.withColumn("category", F.concat_ws(":", "category", F.nullif("lang", F.lit(""))))
    return logprobs.perplexity_by_category(named).select(
        "category",
        "texts",
        "infinite",
        r("avg_perplexity", 3).alias("avg_perplexity"),
        r("avg_logprob").alias("avg_logprob"),
        "token_count",
    )


def _judged(judged: DataFrame) -> DataFrame:
    return judged.select(
        "text_id",
        r(logprobs.finite("compared")).alias("compared"),
        "is_memorized",
        r(logprobs.finite("confidence"), 4).alias("confidence"),
    )


@query
def perplexity_ratio_verdict(spark: SparkSession, sf: str) -> DataFrame:
    scored = stored(inputs.scored_texts(spark, sf, "known", "unseen"), "scored-texts")
    references = scored.where(F.col("category") == "unseen")
    known = scored.where(F.col("category") == "known")
    return _judged(logprobs.ratio_verdict(known, references, threshold=0.5))


@query
def perplexity_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The absolute mode: perplexity itself against the threshold."""
    judged = logprobs.ratio_verdict(inputs.scored_texts(spark, sf, "known"))
    return judged.select(
        "text_id",
        r(logprobs.finite("compared"), 4).alias("compared"),
        "is_memorized",
        r(logprobs.finite("confidence")).alias("confidence"),
    )


@query
def corpus_lm_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    known = inputs.texts(spark, sf, "known")
    rows = corpus_lm.text_token_rows(known, "text_id", "text")
    scored = corpus_lm.score_tokens(rows, read_table(spark, sf, "documents"), "text", "text_id")
    return scored.select("text_id", big("pos").alias("pos"), "token", r("logprob").alias("logprob"))


@query
def corpus_lm_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.scored_texts(spark, sf).select(*_perplexity_columns("text_id"))


def _chat_tokens(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_chat(inputs.chat_bodies(spark, sf))
    return responses.chat_token_rows(parsed, "response_id")


@query
def top_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return logprobs.ranked_alternatives(_chat_tokens(spark, sf), "response_id").select(
        "response_id",
        big("pos").alias("pos"),
        big("rank").alias("rank"),
        "alternative",
        r("logprob").alias("logprob"),
    )


@query
def temperature_top_p(spark: SparkSession, sf: str) -> DataFrame:
    kept = logprobs.temperature_top_p(_chat_tokens(spark, sf), "response_id", 0.7, 0.9)
    return kept.select(
        "response_id",
        big("pos").alias("pos"),
        big("rank").alias("rank"),
        "alternative",
        r("probability").alias("probability"),
        r("nucleus_probability").alias("nucleus_probability"),
    )


@query
def perplexity_outliers(spark: SparkSession, sf: str) -> DataFrame:
    scored = stored(inputs.scored_texts(spark, sf, "known", "unseen"), "scored-texts")
    return logprobs.perplexity_outliers(scored, "unseen").select(
        "text_id", "category", r("z_score", 4).alias("z_score"), "is_outlier"
    )


@query
def contrast_significance(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.scored_texts(spark, sf, "known", "unseen")
    tested = logprobs.contrast_significance(scored, "known", "unseen")
    return tested.select(
        "n_left",
        "n_right",
        "infinite_left",
        "infinite_right",
        r("mean_left").alias("mean_left"),
        r("mean_right").alias("mean_right"),
        r("t_value", 3).alias("t_value"),
        r("degrees", 3).alias("degrees"),
        r("p_value", 6).alias("p_value"),
    )


# --- embeddings --------------------------------------------------------------


@query
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.vector_similarities(spark, sf).select(
        "item_id", "ref_id", r("similarity").alias("similarity")
    )


@query
def embedding_verdict(spark: SparkSession, sf: str) -> DataFrame:
    judged = embeddings.embedding_verdict(inputs.vector_similarities(spark, sf), VECTOR_THRESHOLD)
    return judged.select(
        "item_id", "references", r("memorization_score").alias("memorization_score"), "is_memorized"
    )


@query
def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents")
    return embeddings.text_vectors(documents, "doc_id", "text").select(
        "doc_id", "term", r("weight").alias("weight")
    )


@query
def text_similarity_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Completions against their options as TF-IDF vectors."""
    said = inputs.completions(spark, sf).where(F.col("error").isNull())
    options = inputs.mcq(spark, sf).select("item_id", F.posexplode("options").alias("ref_idx", "text"))
    left = embeddings.text_vectors(said, "response_id", "completion", read_table(spark, sf, "documents"))
    keyed = options.withColumn("ref_id", F.col("item_id") * 4 + F.col("ref_idx"))
    right = embeddings.text_vectors(keyed, "ref_id", "text", read_table(spark, sf, "documents"))
    own = said.select("item_id", "response_id")
    placed = left.join(own, "response_id")
    pairs = embeddings.sparse_similarity(
        placed, right.withColumn("item_id", F.floor(F.col("ref_id") / 4)), "item_id", "ref_id", OUTPUT
    )
    complete = own.join(keyed.select("item_id", "ref_id"), "item_id")
    filled = complete.join(pairs, ["item_id", "response_id", "ref_id"], "left").withColumn(
        "similarity", F.coalesce("similarity", F.lit(0.0))
    )
    return embeddings.embedding_verdict(filled, VECTOR_THRESHOLD, OUTPUT).select(
        "item_id", "response_id", r("memorization_score").alias("memorization_score"), "is_memorized"
    )


@query
def nearest_training_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    nearest = embeddings.nearest_vectors(vectors, vectors, k=5, exclude_same_id=True)
    return embeddings.unusual_neighbours(nearest, VECTOR_THRESHOLD).select(
        "vec_id",
        big("rank").alias("rank"),
        "neighbour_id",
        r("similarity").alias("similarity"),
        "is_unusual",
    )


# --- consistency -------------------------------------------------------------


@query
def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        fx.answer_letter(F.col("text")).alias("letter"),
        fx.answer_letter(F.col("text"), strict=True).alias("strict_letter"),
    )


@planned_once
def _originals(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.original_answers(inputs.original_replies(spark, sf))


@query
def original_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _originals(spark, sf).select(
        "item_id", "answer_text", "original_answer", big("original_idx").alias("original_idx")
    )


@query
def trial_plan(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.trial_plan(inputs.mcq(spark, sf)).select(
        "item_id",
        big("trial").alias("trial"),
        "modification_type",
        F.array_join(F.transform("shown_order", lambda i: i.cast("string")), ",").alias("shown_order"),
        F.md5("prompt").alias("prompt_digest"),
    )


@planned_once
def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.map_trial_answers(inputs.trials(spark, sf))


@query
def map_trial_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select(
        "item_id",
        big("trial").alias("trial"),
        "modification_type",
        "modified_answer",
        big("modified_idx").alias("modified_idx"),
    )


@planned_once
def _consistent(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.consistency_score(_mapped(spark, sf), _originals(spark, sf))


@query
def consistency_score(spark: SparkSession, sf: str) -> DataFrame:
    return _consistent(spark, sf).select(
        "item_id", "trials", "consistent", r("consistency_score").alias("consistency_score")
    )


@query
def consistency_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.consistency_verdict(_consistent(spark, sf)).select(
        "item_id", "original_correct", r("memorization_score").alias("memorization_score"), "is_memorized"
    )


# --- combining and reporting -------------------------------------------------


def detectors(spark: SparkSession, sf: str) -> dict[str, verdict.Detector]:
    """The four detectors by name; a plan is built only when its detector is chosen."""
    return {
        "perplexity": lambda: logprobs.option_perplexity(inputs.option_scores(spark, sf)),
        "ngram": lambda: _ngram_detections(spark, sf).withColumn("threshold", F.lit(0.3)),
        "embedding": lambda: _vector_detections(spark, sf),
        "consistency": lambda: consistency.consistency_verdict(_consistent(spark, sf)),
    }


@planned_once
def _vector_detections(spark: SparkSession, sf: str) -> DataFrame:
    judged = embeddings.embedding_verdict(inputs.vector_similarities(spark, sf), VECTOR_THRESHOLD)
    items = inputs.mcq(spark, sf).select("item_id")
    missing = F.when(F.col("references").isNull(), F.lit("no vector"))
    return items.join(judged, "item_id", "left").withColumn("error", missing)


@planned_once
def detections(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.run_methods(detectors(spark, sf), ["all"])


@planned_once
def _method_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.method_verdicts(detections(spark, sf))


@query
def aggregate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = verdict.aggregate_verdict(inputs.mcq(spark, sf), _method_verdicts(spark, sf))
    return verdicts.select("item_id", r("aggregate_score").alias("aggregate_score"), "is_memorized")


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = inputs.mcq(spark, sf)
    summary = verdict.run_summary(items, verdict.aggregate_verdict(items, _method_verdicts(spark, sf)))
    return summary.withColumn("memorized_score", r("memorized_score")).withColumn(
        "other_score", r("other_score")
    )


@query
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = verdict.aggregate_verdict(inputs.mcq(spark, sf), _method_verdicts(spark, sf))
    return verdict.score_histogram(stored(verdicts, "verdicts")).select(big("bin").alias("bin"), "items")


@query
def combined_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """A detector's score, held to one, is its confidence."""
    judged = _method_verdicts(spark, sf).withColumn("confidence", F.least("memorization_score", F.lit(1.0)))
    return verdict.combined_confidence(judged).select(
        "item_id", "fired", r("confidence").alias("confidence"), "is_memorized"
    )


# --- entities and tables -----------------------------------------------------


@query
def entity_probes(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entity_probes(inputs.entities(spark, sf))


@planned_once
def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entity_hits(inputs.entity_completions(spark, sf), inputs.entity_truth(spark, sf))


@query
def entity_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("entity", "template", "completion", "is_correct")


@planned_once
def _entity_scores(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entity_score(_hits(spark, sf), inputs.entities(spark, sf))


@query
def entity_score(spark: SparkSession, sf: str) -> DataFrame:
    return _entity_scores(spark, sf).select("entity", "probes", r("score").alias("score"))


@planned_once
def _rarity(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents")
    return entities.entity_rarity(inputs.entities(spark, sf), documents, "text")


@query
def entity_rarity(spark: SparkSession, sf: str) -> DataFrame:
    return _rarity(spark, sf).select("entity", "occurrences", r("rarity").alias("rarity"))


@query
def entity_score_by_rarity(spark: SparkSession, sf: str) -> DataFrame:
    banded = entities.score_by_rarity(_entity_scores(spark, sf), _rarity(spark, sf))
    return banded.select(big("rarity_band").alias("rarity_band"), "entities", r("avg_score").alias("avg_score"))


@query
def texts_with_entities(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    named = entities.texts_with_entities(documents, inputs.entities(spark, sf), "doc_id", "text")
    return named.select("doc_id", "lang")


@query
def column_entropy(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        tabular.column_entropy(read_table(spark, sf, name)).withColumn("table_name", F.lit(name))
        for name in ("part", "customer", "orders")
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.select(
        "table_name", F.col("column").alias("column_name"), "distinct_values", r("entropy").alias("entropy")
    )


@query
def csv_column_entropy(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "part-csv")
    read_table(spark, sf, "part").write.option("header", True).csv(path)
    table = read_tabular(spark, path)
    return tabular.column_entropy(table).select(
        F.col("column").alias("column_name"), "distinct_values", r("entropy").alias("entropy")
    )


@query
def row_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return tabular.row_prompts(read_table(spark, sf, "part"), "p_partkey", sample_rows=100)


@planned_once
def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return tabular.extract_row_values(inputs.row_completions(spark, sf), list(inputs.HELD_OUT))


@query
def extract_row_values(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("row_id", F.col("column").alias("column_name"), "predicted")


@planned_once
def _compared(spark: SparkSession, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part")
    actual = tabular.held_out_values(part, "p_partkey", list(inputs.HELD_OUT))
    return tabular.compare_rows(_extracted(spark, sf), actual)


@query
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).select(
        "row_id", F.col("column").alias("column_name"), "predicted", "actual", "is_match"
    )


@query
def row_completion_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.row_completions(spark, sf)
    return tabular.row_accuracy(_compared(spark, sf), rows).select(
        "row_id", "extracted", r("accuracy").alias("accuracy")
    )


# --- duplicates, rates, thresholds, membership --------------------------------


@query
def extraction_rates(spark: SparkSession, sf: str) -> DataFrame:
    pairs = inputs.extraction_pairs(spark, sf)
    return verdict.extraction_rates(pairs, F.col("expected"), F.col("produced")).select(
        "items", r("exact_rate").alias("exact_rate"), r("fractional_rate").alias("fractional_rate")
    )


@query
def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_counts(read_table(spark, sf, "documents"), "doc_id", "text")


@query
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents")
    return dedup.exact_dedup(documents, "doc_id", "text").select("doc_id", "lang", "n_chars")


@query
def score_by_duplication(spark: SparkSession, sf: str) -> DataFrame:
    leaks = contamination.strongest_leak(_contaminated(spark, sf))
    documents = read_table(spark, sf, "documents")
    return dedup.score_by_duplication(documents, leaks, "doc_id", "text").select(
        big("copies_band").alias("copies_band"), "distinct_texts", "texts", r("avg_score").alias("avg_score")
    )


@planned_once
def _likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, likelihood): inverse perplexity of each document, 0.0 for an infinite one."""
    scored = inputs.scored_texts(spark, sf, "corpus")
    return scored.select(
        F.substring("text_id", 2, 20).cast("bigint").alias("doc_id"),
        (1 / F.col("perplexity")).alias("likelihood"),
        "avg_logprob",
        "token_count",
        "lang",
    )


@query
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _likelihoods(spark, sf).join(read_table(spark, sf, "labels"), "doc_id")
    swept = verdict.threshold_sweep(labelled, "likelihood", "quality", SWEEP, group="lang")
    return swept.select(
        "lang",
        "threshold",
        "true_positives",
        "false_positives",
        "false_negatives",
        r("precision").alias("precision"),
        r("recall").alias("recall"),
    )


@query
def calibrated_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Each language by its own threshold: the one of best F1, the lowest if several are."""
    likelihoods = _likelihoods(spark, sf)
    labelled = likelihoods.join(read_table(spark, sf, "labels"), "doc_id")
    swept = verdict.threshold_sweep(labelled, "likelihood", "quality", SWEEP, group="lang")
    hits = 2 * F.col("true_positives")
    f1 = F.round(hits / (hits + F.col("false_positives") + F.col("false_negatives")), 9)
    best = swept.groupBy("lang").agg(F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias("threshold"))
    judged = verdict.calibrated_verdict(likelihoods, best, "lang", "likelihood")
    return judged.select("doc_id", "lang", "threshold", "is_memorized")


@query
def membership_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, which the model is counted on, against conversations, which it never saw."""
    chosen = inputs.texts(spark, sf, "corpus", "unseen")
    benchmark = read_table(spark, sf, "benchmark")
    pairs = contamination.corpus_contamination(benchmark, chosen, doc_id="text_id")
    features = (
        inputs.scored_texts(spark, sf, "corpus", "unseen")
        .join(contamination.strongest_leak(pairs, "text_id"), "text_id", "left")
        .withColumn("log_tokens", F.log1p("token_count"))
        .withColumn("is_member", (F.col("category") == "corpus").cast("int"))
    )
    scored = membership.membership_scores(
        features, "text_id", ["avg_logprob", "leak_score", "log_tokens"], "is_member"
    )
    return scored.withColumn("membership", r("membership", 4))

"""Inputs derived from the given tables, all deterministic.

The tables hold no exam questions, model answers or log-probabilities, so these
are derived from their rows: questions from ``benchmark``, answers from
``conversations``, a language model from ``documents``. Choices that stand for
chance are md5 digests of the row's own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.hashing import pick
from leakscope.functions.text import cased_tokens, explode_rows, index_letter, word_tokens
from leakscope.operators import corpus_lm, prompts
from leakscope.operators.embeddings import cosine_pairs
from leakscope.operators.entities import entity_probes, truth_key
from leakscope.operators.logprobs import sequence_perplexity
from leakscope.plans.frames import planned_once, read_table
from leakscope.session import stored
from leakscope.sources.responses import parse_completions

UNSURE = "I am not sure"
LETTERS = "ABCD"
PIECES = r"\s*\S+"
ENTITY_SHARE = 0.02


def size_by_id(table: DataFrame, key: str) -> Column:
    """Number of ids of a table whose ids count up from zero."""
    return table.agg(F.max(key) + 1).scalar()


@planned_once
def mcq(spark: SparkSession, sf: str) -> DataFrame:
    """Four-option questions from ``benchmark``.

    The first half of an item's words is the question, the rest is the correct
    option at position ``item_id % 4``; the continuations of the next three
    items fill the other positions. Each continuation is sent to the four items
    that show it, so one grouping builds all options.
    """
    benchmark = read_table(spark, sf, "benchmark")
    count = size_by_id(benchmark, "item_id")
    words = benchmark.select("item_id", word_tokens(F.col("text")).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    split = words.select(
        "item_id",
        F.slice("w", 1, half).alias("stem"),
        F.slice("w", half + 1, F.size("w")).alias("rest"),
    )
    sent = split.select(
        F.col("item_id").alias("source"),
        F.array_join("stem", " ").alias("question"),
        F.element_at("stem", -1).alias("last_word"),
        F.array_join("rest", " ").alias("continuation"),
        F.explode(F.array(*[F.lit(d) for d in range(4)])).alias("distance"),
    ).withColumn("item_id", F.pmod(F.col("source") - F.col("distance"), count))
    place = F.pmod(F.col("item_id") + F.col("distance"), F.lit(4))
    own = F.col("distance") == 0
    options = [F.max(F.when(place == o, F.col("continuation"))).alias(f"o{o}") for o in range(4)]
    grouped = sent.groupBy("item_id").agg(
        F.max(F.when(own, F.col("question"))).alias("question"),
        F.max(F.when(own, F.col("last_word"))).alias("last_word"),
        F.max(F.when(own, F.col("continuation"))).alias("continuation"),
        *options,
    )
    return grouped.where(F.col("question").isNotNull()).select(
        "item_id",
        "question",
        F.array(*[F.coalesce(f"o{o}", F.lit("")) for o in range(4)]).alias("options"),
        (F.col("item_id") % 4).cast("int").alias("correct_idx"),
        "last_word",
        "continuation",
    )


@planned_once
def raw_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Records as a loader finds them: options by letter, answers as letter or text."""
    items = mcq(spark, sf)
    kind = pick(4, F.col("item_id"), "answer")
    text = F.col("continuation")
    written = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit(" \t"), F.upper(text), F.lit("\n")))
        .when(kind == 2, F.substring(text, F.lit(1), F.length(text) - 1))
        .otherwise(F.lit("no such answer"))
    )
    answer = F.when(F.col("item_id") % 2 == 0, index_letter(F.col("correct_idx"))).otherwise(written)
    draw = pick(10, F.col("item_id"), "split")
    split = F.when(draw < 8, "train").when(draw == 8, "validation").otherwise("test")
    return items.select(
        F.concat(F.lit("q"), F.col("item_id")).alias("id"),
        "question",
        F.struct(*[F.get(F.col("options"), i).alias(c) for i, c in enumerate(LETTERS)]).alias("options"),
        answer.alias("answer"),
        split.alias("split"),
    )


@planned_once
def completion_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One completion response per assistant turn; a third leak the answer, some are unusable.

    A conversation answers the question ``conv_id`` modulo their number, so a question
    has many outputs, told apart by response_id. A leak stands before the turn's text.
    """
    turns = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    count = size_by_id(read_table(spark, sf, "benchmark"), "item_id")
    said = turns.select(
        F.pmod(F.col("conv_id"), count).alias("item_id"),
        F.concat_ws("-", "conv_id", "turn").alias("response_id"),
        F.coalesce("text", F.lit("")).alias("reply"),
    )
    words = F.split("continuation", " ")
    first_half = F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int")), " ")
    leak = F.concat(F.lit("Answer "), index_letter(F.col("correct_idx")), F.lit(". "), first_half)
    leaks = mcq(spark, sf).select("item_id", leak.alias("leak"))
    leaked = pick(3, F.col("response_id"), "leak") == 0
    text = F.when(leaked, F.concat("leak", F.lit(" "), "reply")).otherwise(F.col("reply"))
    kind = pick(8, F.col("item_id"), F.col("response_id"), "completion")
    message = F.struct(F.struct(F.col("_text").alias("content")).alias("message"))
    body = (
        F.when(kind == 0, '{"choices": []}')
        .when(kind == 1, '{"error": {"message": "overloaded"}}')
        .when(kind == 2, "{bad json")
        .otherwise(F.to_json(F.struct(F.array(message).alias("choices"))))
    )
    return said.join(leaks, "item_id").withColumn("_text", text).select("item_id", "response_id", body.alias("body"))


@planned_once
def completions(spark: SparkSession, sf: str) -> DataFrame:
    return parse_completions(completion_bodies(spark, sf))


@planned_once
def original_replies(spark: SparkSession, sf: str) -> DataFrame:
    """The model's reply to each unmodified prompt."""
    items = mcq(spark, sf)
    kind = pick(10, F.col("item_id"), "original")
    right = F.col("correct_idx")
    other = F.pmod(right + 1, F.lit(4))
    reply = (
        F.when(kind < 7, _reply(F.col("options"), right))
        .when(kind == 7, _reply(F.col("options"), other))
        .when(kind == 8, F.concat(F.lit("Answer: "), index_letter(right)))
        .otherwise(F.lit(UNSURE))
    )
    return items.select("item_id", "question", "options", "correct_idx", reply.alias("answer_text"))


@planned_once
def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Five modified prompts per question with the model's replies."""
    planned = prompts.trial_plan(mcq(spark, sf))
    kind = pick(10, F.col("item_id"), F.col("trial"), "reply")
    right = (F.array_position("shown_order", F.col("correct_idx")) - 1).cast("int")
    other = F.pmod(right + 1, F.lit(4))
    shown = F.col("options_shown")
    reply = (
        F.when(kind < 6, _reply(shown, right)).when(kind < 9, _reply(shown, other)).otherwise(UNSURE)
    )
    return planned.withColumn("answer_text", reply)


def _reply(options: Column, index: Column) -> Column:
    return F.concat(index_letter(index), F.lit(". "), F.get(options, index))


@planned_once
def option_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(seq_id, tokens): last question word and one option; seq_id = 4 * item + option."""
    rows = mcq(spark, sf).select("item_id", "last_word", F.posexplode("options").alias("o", "option"))
    return rows.select(
        (F.col("item_id") * 4 + F.col("o")).alias("seq_id"),
        F.concat(F.array("last_word"), word_tokens(F.col("option"))).alias("tokens"),
    )


@planned_once
def option_token_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    """Option words scored by the bigram model of ``documents``."""
    rows = corpus_lm.token_rows(option_sequences(spark, sf), "seq_id", F.col("tokens"))
    documents = read_table(spark, sf, "documents")
    return corpus_lm.score_tokens(rows, documents, "text", "seq_id")


@planned_once
def option_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, option_idx, correct_idx, logprob): mean log-probability per option."""
    scored = option_token_logprobs(spark, sf).groupBy("seq_id").agg(F.avg("logprob").alias("logprob"))
    item = F.floor(F.col("seq_id") / 4)
    return scored.select(
        item.alias("item_id"),
        (F.col("seq_id") % 4).cast("int").alias("option_idx"),
        (item % 4).cast("int").alias("correct_idx"),
        "logprob",
    )


@planned_once
def texts(spark: SparkSession, sf: str, *categories: str) -> DataFrame:
    """(text_id, category, lang, text): known, corpus, random (known ones read backwards) and unseen."""
    documents, benchmark = (read_table(spark, sf, name) for name in ("documents", "benchmark"))
    parts = {
        "known": benchmark.select(
            F.concat(F.lit("b"), F.col("item_id")).alias("text_id"),
            F.lit("known").alias("category"),
            F.lit("").alias("lang"),
            "text",
        ),
        "corpus": documents.select(
            F.concat(F.lit("d"), F.col("doc_id")).alias("text_id"),
            F.lit("corpus").alias("category"),
            "lang",
            "text",
        ),
        "random": benchmark.select(
            F.concat(F.lit("r"), F.col("item_id")).alias("text_id"),
            F.lit("random").alias("category"),
            F.lit("").alias("lang"),
            F.reverse("text").alias("text"),
        ),
        "unseen": read_table(spark, sf, "conversations").select(
            F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("text_id"),
            F.lit("unseen").alias("category"),
            F.lit("").alias("lang"),
            "text",
        ),
    }
    chosen = [parts[name] for name in (categories or parts)]
    union = chosen[0]
    for more in chosen[1:]:
        union = union.unionByName(more)
    return union


@planned_once
def scored_texts(spark: SparkSession, sf: str, *categories: str) -> DataFrame:
    """Perplexity of each text under the bigram model of ``documents``."""
    chosen = texts(spark, sf, *categories)
    in_model = F.col("category") == "corpus"
    if categories and "corpus" not in categories:
        rows = corpus_lm.token_rows(chosen, "text_id", corpus_lm.word_hashes(F.col("text")))
        documents = read_table(spark, sf, "documents")
        scored = corpus_lm.score_tokens(rows, documents, "text", "text_id", hashed=True)
    else:
        key = F.struct("text_id", in_model.alias("in_model")).alias("key")
        tagged = stored(chosen.select(key, corpus_lm.word_hashes(F.col("text")).alias("words")), "text-words")
        rows = corpus_lm.token_rows(tagged, "key", F.col("words")).select("key.*", "prev", "token")
        scored = corpus_lm.score_own_tokens(rows, "text_id", "in_model")
    stats = sequence_perplexity(scored, "text_id")
    # A text without words has no token rows, but a row here.
    missing = {"avg_logprob": 0.0, "token_count": 0, "valid_count": 0, "is_infinite": True, "perplexity": float("inf")}
    return chosen.select("text_id", "category", "lang").join(stats, "text_id", "left").fillna(missing)


@planned_once
def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns cut into pieces that join back to the text."""
    turns = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(PIECES), F.lit(0))
    cut = turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
            "response_id"
        ),
        pieces.alias("pieces"),
    )
    half = F.floor(F.size("pieces") / 2).cast("int")
    return cut.withColumn(
        "prompt_chars", F.length(F.array_join(F.slice("pieces", 1, half), ""))
    ).withColumn("total_chars", F.length(F.array_join("pieces", "")))


def _unusable(kind: Column, good: Column) -> Column:
    return (
        F.when(kind == 0, '{"choices": []}')
        .when(kind == 1, '{"choices": [{"logprobs": null}]}')
        .when(
            kind == 2,
            '{"choices": [{"logprobs": {"tokens": [], "token_logprobs": [], "content": []}}]}',
        )
        .when(kind == 3, "{bad json")
        .otherwise(good)
    )


@planned_once
def legacy_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Echo responses: every piece and one generated token, the first without score."""
    scored = F.transform(
        F.col("pieces"),
        lambda p, i: F.when(i > 0, corpus_lm.rule_logprob(p)),
    )
    logprobs = F.struct(
        F.concat(F.col("pieces"), F.array(F.lit(" generated"))).alias("tokens"),
        F.concat(scored, F.array(F.lit(-5.0))).alias("token_logprobs"),
    )
    choice = F.struct(logprobs.alias("logprobs"))
    good = F.to_json(F.struct(F.array(choice).alias("choices")))
    kind = pick(10, F.col("response_id"), "legacy")
    return replies(spark, sf).select(
        "response_id", "prompt_chars", "total_chars", _unusable(kind, good).alias("body")
    )


@planned_once
def chat_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Chat responses with three alternatives per piece."""

    def entry(piece: Column, i: Column) -> Column:
        logprob = corpus_lm.rule_logprob(piece)
        gap = F.lit(0.2) * ((i + F.length(piece)) % 5 + 1)
        others = [(piece, logprob), (F.lit("the"), logprob - gap), (F.lit("of"), logprob - 1.9)]
        top = F.array(
            *[
                F.struct(
                    t.alias("token"), lp.alias("logprob"), F.array(F.ascii(t)).alias("bytes")
                )
                for t, lp in others
            ]
        )
        return F.struct(piece.alias("token"), logprob.alias("logprob"), top.alias("top_logprobs"))

    content = F.struct(F.transform(F.col("pieces"), entry).alias("content"))
    good = F.to_json(F.struct(F.array(F.struct(content.alias("logprobs"))).alias("choices")))
    kind = pick(10, F.col("response_id"), "chat")
    return replies(spark, sf).select("response_id", _unusable(kind, good).alias("body"))


@planned_once
def vector_references(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, ref_id): the four vectors after each vector."""
    vectors = read_table(spark, sf, "embeddings")
    count = size_by_id(vectors, "vec_id")
    return vectors.select(
        F.col("vec_id").alias("item_id"),
        F.explode(F.array(*[F.pmod(F.col("vec_id") + r, count) for r in range(1, 5)])).alias("ref_id"),
    )


@planned_once
def vector_similarities(spark: SparkSession, sf: str) -> DataFrame:
    pairs = vector_references(spark, sf)
    return cosine_pairs(pairs, read_table(spark, sf, "embeddings"), "item_id", "ref_id")


@planned_once
def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words of at least five letters in one document of fifty, and regions.

    The share bounds the list: fifty times the words of an average document.
    """
    documents = read_table(spark, sf, "documents")
    count = documents.agg(F.count("*")).scalar()
    words = F.array_distinct(
        F.filter(cased_tokens(F.col("text")), lambda w: w.rlike("^[A-Z][a-z]{4,}$"))
    )
    frequent = (
        explode_rows(documents, words, "entity")
        .groupBy("entity")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= count * ENTITY_SHARE)
        .select("entity")
    )
    regions = read_table(spark, sf, "region").select(F.col("r_name").alias("entity"))
    return stored(frequent.unionByName(regions), "entities")


@planned_once
def followers(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, follower): the word that most often comes right after the entity."""
    listed = entities(spark, sf)
    documents = read_table(spark, sf, "documents")
    words = documents.select(cased_tokens(F.col("text")).alias("w"))
    pairs = F.zip_with(
        F.col("w"),
        F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("entity"), b.alias("follower")),
    )
    rows = explode_rows(words, pairs, "p").select("p.*").where(F.col("follower").isNotNull())
    counts = rows.join(listed, "entity", "left_semi").groupBy("entity", "follower").agg(
        F.count("*").alias("n")
    )
    best = F.max(F.struct("n", "follower"))
    return stored(counts.groupBy("entity").agg(best["follower"].alias("follower")), "followers")


@planned_once
def entity_truth(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.array_distinct(F.array(*[truth_key(F.lit(t)) for t in config.ENTITY_TEMPLATES]))
    return followers(spark, sf).select(
        "entity", F.explode(keys).alias("key"), F.col("follower").alias("expected")
    )


@planned_once
def entity_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completions of the probes: right in two of three cases where a truth is known."""
    probes = entity_probes(entities(spark, sf)).join(followers(spark, sf), "entity", "left")
    kind = pick(3, F.col("entity"), F.col("template"))
    text = (
        F.when(F.col("follower").isNull() | (kind == 1), "unknown")
        .when(kind == 0, F.concat(F.lit("It is "), F.upper("follower")))
        .otherwise(F.concat(F.col("follower"), F.lit(" indeed")))
    )
    return probes.select("entity", "template", text.alias("completion"))


HELD_OUT = ("p_type", "p_size", "p_retailprice")


@planned_once
def row_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completed rows of ``part`` with omissions, errors and longer values."""
    part = read_table(spark, sf, "part")
    lines = []
    for column in HELD_OUT:
        kind = pick(5, F.col("p_partkey"), column)
        value = F.col(column).cast("string")
        shown = F.when(kind == 1, F.lit("zzz")).when(kind == 2, F.concat(value, F.lit(" x")))
        lines.append(
            F.when(kind > 0, F.concat(F.lit(f"{column}: "), shown.otherwise(value)))
        )
    return part.select(F.col("p_partkey").alias("row_id"), F.concat_ws("\n", *lines).alias("completion"))


@planned_once
def probe_completions(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, variant, completion): the true continuation, a shifted one, or a later part."""
    documents = read_table(spark, sf, "documents")
    text = F.col("text")
    kind = pick(3, F.col("doc_id"), F.col("variant"), "probe")
    completion = (
        F.when(kind == 0, F.substring(text, 101, 200))
        .when(kind == 1, F.concat(F.substring(text, 101, 100), F.substring(text, 1, 100)))
        .otherwise(F.substring(text, 301, 200))
    )
    variants = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("variant")
    return documents.select("doc_id", "text", variants).select(
        "doc_id", "variant", completion.alias("completion")
    )


@planned_once
def dialogue_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with the user turn right before them."""
    turns = read_table(spark, sf, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("reply")
    )
    return answered.join(asked, ["conv_id", "turn"])


@planned_once
def extraction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, expected, produced) word arrays, reproduced in whole, in part or not."""
    items = mcq(spark, sf)
    expected = F.split("continuation", " ")
    half = F.slice(expected, 1, F.floor(F.size(expected) / 2).cast("int"))
    other = F.split(F.get(F.col("options"), F.pmod(F.col("correct_idx") + 1, F.lit(4))), " ")
    kind = pick(4, F.col("item_id"), "extraction")
    produced = (
        F.when(kind == 0, expected)
        .when(kind == 1, half)
        .when(kind == 2, other)
        .otherwise(F.concat(half, F.split("question", " ")))
    )
    return items.select("item_id", expected.alias("expected"), produced.alias("produced"))

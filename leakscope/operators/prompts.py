"""Prompt projections and the request table that leaves for a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.hashing import pick, shuffled_positions
from leakscope.functions.text import index_letter


def lettered_options(options: Column) -> Column:
    lines = F.transform(
        options, lambda o, i: F.concat(index_letter(i), F.lit(". "), o, F.lit("\n"))
    )
    return F.array_join(lines, "")


def multiple_choice_prompt(question: Column, options: Column) -> Column:
    return F.concat(
        F.lit("Question: "),
        question,
        F.lit("\n\nOptions:\n"),
        lettered_options(options),
        F.lit("\nAnswer:"),
    )


def explanation_prompt(question: Column, options: Column) -> Column:
    return _open_prompt(question, options, config.EXPLANATION_REQUEST)


def stepwise_prompt(question: Column, options: Column) -> Column:
    return _open_prompt(question, options, config.STEPWISE_REQUEST)


def _open_prompt(question: Column, options: Column, request: str) -> Column:
    return F.concat(
        F.lit("Question: "),
        question,
        F.lit("\n\nOptions:\n"),
        lettered_options(options),
        F.lit("\n\n" + request),
    )


def rephrased(question: Column, *key) -> Column:
    """A lead-in chosen by the key before the lower-cased question."""
    lead_ins = F.array(*[F.lit(p) for p in config.LEAD_INS])
    choice = pick(len(config.LEAD_INS), *key, "lead").cast("int") + 1
    return F.concat(F.element_at(lead_ins, choice), F.lower(question))


def trial_plan(
    items: DataFrame,
    trials: int = config.CONSISTENCY_TRIALS,
    types: tuple[str, ...] = config.MODIFICATION_TYPES,
) -> DataFrame:
    """``trials`` modified prompts per item: type, options as shown and prompt."""
    numbered = items.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    key = (F.col("item_id"), F.col("trial"))
    kinds = F.array(*[F.lit(t) for t in types])
    chosen = numbered.withColumn(
        "modification_type", F.element_at(kinds, pick(len(types), *key, "type").cast("int") + 1)
    )
    return modified_prompts(chosen, key)


def modified_prompts(chosen: DataFrame, key: tuple) -> DataFrame:
    """Apply the reordering and rephrasing a ``modification_type`` column names."""
    kind = F.col("modification_type")
    order = F.when(kind == "rephrased", F.sequence(F.lit(0), F.size("options") - 1)).otherwise(
        shuffled_positions(F.size("options"), *key)
    )
    shown = F.when(
        F.size("options") > 0,
        F.transform(F.col("shown_order"), lambda i: F.get(F.col("options"), i)),
    ).otherwise(F.col("options"))
    asked = F.when(kind == "reordered", F.col("question")).otherwise(
        rephrased(F.col("question"), *key)
    )
    return (
        chosen.withColumn("shown_order", order)
        .withColumn("options_shown", shown)
        .withColumn("prompt", multiple_choice_prompt(asked, F.col("options_shown")))
    )


def chat_body(model: str, prompt: Column, temperature: float, max_tokens: int) -> Column:
    """Body of a chat completion request."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(message).alias("messages"),
            F.lit(temperature).alias("temperature"),
            F.lit(max_tokens).alias("max_tokens"),
        )
    )


def echo_body(model: str, prompt: Column) -> Column:
    """Body of a completion request that echoes the prompt with log-probabilities."""
    temperature, max_tokens = config.LOGPROB_SETTINGS
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            prompt.alias("prompt"),
            F.lit(temperature).alias("temperature"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(True).alias("logprobs"),
            F.lit(config.TOP_LOGPROBS).alias("top_logprobs"),
            F.lit(True).alias("echo"),
        )
    )


def chat_logprob_body(model: str, prompt: Column) -> Column:
    """Body of a one-token chat request with log-probabilities."""
    temperature, max_tokens = config.LOGPROB_SETTINGS
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(message).alias("messages"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(temperature).alias("temperature"),
            F.lit(True).alias("logprobs"),
            F.lit(config.TOP_LOGPROBS).alias("top_logprobs"),
        )
    )


def request_table(
    items: DataFrame,
    model: str,
    trials: int = config.CONSISTENCY_TRIALS,
    methods: tuple[str, ...] = ("perplexity", "ngram", "embedding", "consistency"),
    separator: str = "",
) -> DataFrame:
    """One request per (item, method, part); ``part`` is the option or trial number."""
    question, options = F.col("question"), F.col("options")
    shapes = ["item_id bigint", "method string", "part int", "body string"]
    built = []
    if "perplexity" in methods:
        option_rows = items.select("item_id", "question", F.posexplode("options"))
        full_text = F.concat(question, F.lit(separator), F.col("col"))
        built.append(_requests(option_rows, "perplexity", F.col("pos"), echo_body(model, full_text)))
    if "ngram" in methods:
        body = chat_body(model, explanation_prompt(question, options), *config.EXPLANATION_SETTINGS)
        built.append(_requests(items, "ngram", F.lit(0), body))
    if "embedding" in methods:
        body = chat_body(model, stepwise_prompt(question, options), *config.EXPLANATION_SETTINGS)
        built.append(_requests(items, "embedding", F.lit(0), body))
    if "consistency" in methods:
        body = chat_body(model, multiple_choice_prompt(question, options), *config.ANSWER_SETTINGS)
        built.append(_requests(items, "consistency", F.lit(0), body))
        planned = trial_plan(items, trials)
        body = chat_body(model, F.col("prompt"), *config.ANSWER_SETTINGS)
        built.append(_requests(planned, "consistency", F.col("trial"), body))
    if not built:
        raise ValueError(f"no known method among {methods}; rows would be {', '.join(shapes)}")
    return reduce(DataFrame.unionByName, built)


def _requests(rows: DataFrame, method: str, part: Column, body: Column) -> DataFrame:
    return rows.select(
        "item_id",
        F.lit(method).alias("method"),
        part.cast("int").alias("part"),
        body.alias("body"),
    )


def prefix_probes(texts: DataFrame, id_col: str, text_col: str, variants: int = 3) -> DataFrame:
    """Up to three continuation prompts per text with the true continuation."""
    shown = F.substring(F.col(text_col), 1, config.PROBE_PREFIX_CHARS)
    truth = F.substring(
        F.col(text_col), config.PROBE_PREFIX_CHARS + 1, config.PROBE_TRUTH_CHARS
    )
    prompts = F.array(*[F.concat(F.lit(w), shown) for w in config.PROBE_WORDINGS[:variants]])
    return texts.select(
        id_col, truth.alias("truth"), F.posexplode(prompts).alias("variant", "prompt")
    )

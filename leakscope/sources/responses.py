"""Model responses: JSON text in, typed rows out, bad rows set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import schemas


CORRUPT = "_corrupt_record"


def _parsed(body: str, schema: str) -> Column:
    """The response as a struct; broken JSON fills the extra corrupt-record field."""
    return F.from_json(
        F.col(body), f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}
    )


def _broken() -> Column:
    return F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()


def parse_completions(responses: DataFrame, body: str = "body") -> DataFrame:
    """Completion text and, for unusable responses, the reason.

    A response without a list of choices yields the empty text, as does a
    choice without content; an empty list or broken JSON is an error.
    """
    rows = responses.withColumn("_r", _parsed(body, schemas.COMPLETION_RESPONSE))
    reason = (
        F.when(_broken(), "malformed")
        .when(F.size("_r.choices") == 0, "no_choices")
    )
    content = F.coalesce(F.get(F.col("_r.choices"), 0)["message"]["content"], F.lit(""))
    return (
        rows.withColumn("error", reason)
        .withColumn("completion", F.when(F.col("error").isNull(), content))
        .drop("_r", body)
    )


def parse_legacy(responses: DataFrame, body: str = "body") -> DataFrame:
    """Token and log-probability arrays of echo responses, with a reason if bad."""
    rows = responses.withColumn("_r", _parsed(body, schemas.LEGACY_LOGPROB_RESPONSE))
    logprobs = F.get(F.col("_r.choices"), 0)["logprobs"]
    rows = rows.withColumn("tokens", logprobs["tokens"]).withColumn(
        "token_logprobs", logprobs["token_logprobs"]
    )
    shorter = F.least(_length("tokens"), _length("token_logprobs"))
    return _with_reason(rows, logprobs, shorter).drop("_r", body)


def parse_chat(responses: DataFrame, body: str = "body") -> DataFrame:
    """Content array (token, log-probability, alternatives), with a reason if bad."""
    rows = responses.withColumn("_r", _parsed(body, schemas.CHAT_LOGPROB_RESPONSE))
    logprobs = F.get(F.col("_r.choices"), 0)["logprobs"]
    rows = rows.withColumn("content", logprobs["content"])
    return _with_reason(rows, logprobs, _length("content")).drop("_r", body)


def _length(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0))


def _with_reason(rows: DataFrame, logprobs: Column, tokens: Column) -> DataFrame:
    reason = (
        F.when(_broken(), "malformed")
        .when(F.coalesce(F.size("_r.choices"), F.lit(0)) <= 0, "no_choices")
        .when(logprobs.isNull(), "no_logprobs")
        .when(tokens <= 0, "no_tokens")
    )
    return rows.withColumn("error", reason)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("error")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull())


def legacy_token_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, token, logprob); the first log-probability may be null."""
    zipped = F.arrays_zip(
        F.col("tokens").alias("token"), F.col("token_logprobs").alias("logprob")
    )
    return _positions(parsed, zipped, *keys).select(*keys, "pos", "_t.token", "_t.logprob")


def chat_token_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, token, logprob, top_logprobs)."""
    return _positions(parsed, F.col("content"), *keys).select(
        *keys,
        "pos",
        F.coalesce("_t.token", F.lit("")).alias("token"),
        F.col("_t.logprob").alias("logprob"),
        F.col("_t.top_logprobs").alias("top_logprobs"),
    )


def _positions(parsed: DataFrame, array: Column, *keys: str) -> DataFrame:
    """One row per element of usable responses.

    Bad responses become empty arrays instead of being filtered out first: the
    filter would be pushed below the parser and parse every response twice.
    """
    usable = F.when(F.col("error").isNull(), array)
    rows = parsed.select(*keys, F.posexplode_outer(usable).alias("pos", "_t"))
    return rows.where(F.col("pos").isNotNull())

"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm import (
    chat,
    decontamination,
    jaccard_join,
    lexical_search,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    token_counts,
    token_files,
    url_filter,
    warc,
    whitening,
)
from leakscope.llm.common import LAST_ID, once, text_or_empty
from leakscope.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary package keeps a file; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """The documents packed with the 50k byte-level vocabulary."""
    import public_tokenizers

    return packing.pack(
        docs, tokenizer_path(), ranks=tokenizer_path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN
    )


@query
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packed(table(spark, sf, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents put in under two tokenizers, exact copies taken out, repeated lines revised away.

    Every batch but the first is committed twice; the second time changes nothing.
    """
    text = text_or_empty("text")
    revised = token_counts.without_repeated_lines(text)
    counted = once(
        table(spark, sf, "documents").select(
            F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("doc"),
            "source",
            "lang",
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit(1), text).alias("h2"),
            *[count(text).alias(name) for name, count in token_counts.TOKENIZERS.items()],
            *[count(revised).alias(f"{name}_revised") for name, count in token_counts.TOKENIZERS.items()],
        ),
        "counted",
    )
    firsts = once(counted.groupBy("h1", "h2").agg(F.min("doc").alias("first")), "first-texts")
    placed = once(counted.join(firsts, ["h1", "h2"]), "placed")
    copies, kept = placed.where("doc > first"), placed.where("doc = first")
    root = shared_folder(spark, "token-counts")
    for name in token_counts.TOKENIZERS:
        token_counts.commit(token_counts.changes(counted, name, name), root, f"{name}-inserted")
        for _ in range(2):
            token_counts.commit(token_counts.changes(copies, name, name, -1), root, f"{name}-deleted")
            token_counts.commit(token_counts.revisions(kept, name, name, f"{name}_revised"), root, f"{name}-revised")
    return token_counts.totals(spark, root)


@query
def op3_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))


@query
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path, least_bytes=0)
    payload = F.col("payload")
    records = once(
        warc.read_archives(spark, path).select(
            "page_id",
            F.octet_length(payload).cast("bigint").alias("payload_bytes"),
            F.coalesce(warc.sha1_base32(payload), "payload_digest").alias("payload_digest"),
            "record_type",
            "refers_to",
            "fault",
        ),
        "records",
    )
    revisited = records.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("wanted")).distinct()
    responses = once(
        records.where("record_type = 'response'")
        .join(revisited, F.col("page_id") == F.col("wanted"), "left_semi")
        .groupBy(F.col("page_id").alias("refers_to"))
        .agg(F.max("payload_bytes").alias("referred_bytes")),
        "responses",
    )
    return records.join(responses, "refers_to", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "referred_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        "fault",
    )


@query
def op5_chat(spark: SparkSession, sf: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    conversations = table(spark, sf, "conversations").select(more.columns).union(more)
    return chat.digests(chat.format_turns(conversations))


@query
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "changed")


@query
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near copies of all non-blank lines, however short."""
    cut = line_dedup.deduplicate(table(spark, sf, "documents"), near_chars=1)
    return cut.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_exact", "n_near", F.md5("kept_text").alias("kept_md5")
    )


URL_RULES = [
    url_filter.parse_rule(rule)
    for rule in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
]


@query
def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages"), URL_RULES)


@query
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf, "documents"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("broken", " ").alias("broken"),
    )


@query
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf, "embeddings"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op13_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    rows = token_files.read_token_files(spark, path)
    digests = once(rows.select("part", "place", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-digests")
    return token_files.with_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")

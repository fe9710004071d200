"""Question tables: reading a split, normalising records, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.functions.hashing import hash_key
from leakscope.functions.similarity import closest_option
from leakscope.functions.text import letter_index, strip
from leakscope.operators.prompts import multiple_choice_prompt


def read_questions(spark: SparkSession, path: str, split: str = "train", fmt: str = "parquet") -> DataFrame:
    """Records of one split; a table partitioned by ``split`` is pruned to it."""
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(f"{schemas.RAW_QUESTION}, split string")
    return select_split(reader.load(path), split)


def select_split(questions: DataFrame, split: str = "train") -> DataFrame:
    return questions.where(F.col("split") == split)


def option_array(options: Column) -> Column:
    """Options A-D in order, '' where one is missing."""
    return F.array(*[F.coalesce(options[name], F.lit("")) for name in "ABCD"])


def exact_answer_index(options: Column, answer: Column) -> Column:
    """First option equal to the answer: trimmed, then also ignoring case; else null."""
    trimmed = F.transform(options, lambda o: strip(o))
    folded = F.transform(options, lambda o: F.lower(strip(o)))
    equal = F.array_position(trimmed, strip(answer))
    alike = F.array_position(folded, F.lower(strip(answer)))
    return F.coalesce(F.nullif(equal, F.lit(0)), F.nullif(alike, F.lit(0))).cast("int") - 1


def letter_answer_index(answer: Column) -> Column:
    """Index of a one-letter answer, null for longer texts."""
    return F.when(F.length(answer) == 1, letter_index(answer))


def answer_index(df: DataFrame, options: str, answer: str, alias: str, closest: bool = True) -> DataFrame:
    """Resolve answer texts to option indexes, -1 where nothing is close enough."""
    exact = exact_answer_index(F.col(options), F.col(answer))
    staged = df.withColumn(alias, exact)
    if closest:
        guess = closest_option(F.col(options), F.col(answer))
        staged = staged.withColumn(alias, F.coalesce(F.col(alias), guess))
    return staged.withColumn(alias, F.coalesce(F.col(alias), F.lit(-1)))


def preprocess_questions(raw: DataFrame, closest: bool = True) -> DataFrame:
    """Raw records to multiple-choice rows with prompt and answer index.

    An answer that cannot be resolved leaves a null index for the detectors to
    report, never a wrong option.
    """
    rows = raw.select(
        F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("question", F.lit("")).alias("question"),
        option_array(F.col("options")).alias("options"),
        F.coalesce("answer", F.lit("")).alias("correct_answer"),
    )
    resolved = answer_index(rows, "options", "correct_answer", "_by_text", closest)
    by_letter = letter_answer_index(F.col("correct_answer"))
    in_range = by_letter.between(0, F.size("options") - 1)
    by_text = F.when(F.col("_by_text") >= 0, F.col("_by_text"))
    return resolved.select(
        "id",
        "question",
        "options",
        multiple_choice_prompt(F.col("question"), F.col("options")).alias("formatted_prompt"),
        "correct_answer",
        F.coalesce(F.when(in_range, by_letter), by_text).alias("correct_idx"),
    )


def seeded_sample(df: DataFrame, rows: int, key: str, seed: int = 42) -> DataFrame:
    """``rows`` rows without replacement in md5 order of (seed, key); all if fewer.

    The key is unique. A histogram over the first four hex digits, at most 65,536
    counts in one row, finds the digest range that is taken whole; only the keys of
    the bucket at its edge are ranked. The rows follow by a join on the key.
    """
    keys = df.select(key, hash_key(seed, F.col(key)).alias("_order"))
    keys = keys.withColumn("_bucket", F.substring("_order", 1, 4))
    counts = keys.groupBy("_bucket").agg(F.count("*").alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct(F.col("_bucket").alias("bucket"), "n"))).alias("h"))
    start = F.struct(F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("string").alias("edge"))

    def step(state: Column, item: Column) -> Column:
        fits = state["edge"].isNull() & (state["taken"] + item["n"] <= rows)
        taken = F.when(fits, state["taken"] + item["n"]).otherwise(state["taken"])
        edge = F.when(fits | state["edge"].isNotNull(), state["edge"]).otherwise(item["bucket"])
        return F.struct(taken.alias("taken"), edge.alias("edge"))

    cut = listed.select(F.aggregate("h", start, step)).scalar()
    marked = keys.withColumn("_cut", cut)
    inside = marked.where(F.col("_cut.edge").isNull() | (F.col("_bucket") < F.col("_cut.edge")))
    in_bucket = Window.partitionBy("_bucket").orderBy("_order", key)
    edge = marked.where(F.col("_bucket") == F.col("_cut.edge")).withColumn("_rank", F.row_number().over(in_bucket))
    rest = edge.where(F.col("_rank") + F.col("_cut.taken") <= rows)
    return df.join(inside.select(key).union(rest.select(key)), key, "left_semi")

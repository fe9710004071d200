"""Log-probability and perplexity operators over token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.significance import two_sided_p
from leakscope.functions.similarity import character_pairs, pair_similarity, share_of_pairs
from leakscope.operators.scaling import running_sums


def continuation_logprob(
    tokens: DataFrame, seq_id: str, skip_null_length: bool = False
) -> DataFrame:
    """Mean log-probability of the continuation of each sequence.

    ``tokens``: (seq_id, pos, token, logprob, prompt_chars, total_chars). A token
    belongs to the continuation if it ends after the prompt and starts before
    the end of the text; none gives 0.0. ``skip_null_length`` leaves tokens
    without a log-probability out of the running length and keeps every later
    token, generated ones included.
    """
    length = F.length("token")
    if skip_null_length:
        length = F.when(F.col("logprob").isNotNull(), length).otherwise(0)
    placed = running_sums(tokens, seq_id, "pos", {"end_chars": length})
    inside = F.col("end_chars") > F.col("prompt_chars")
    if not skip_null_length:
        inside = inside & (F.col("end_chars") - F.length("token") < F.col("total_chars"))
    kept = F.when(inside, F.col("logprob"))
    return placed.groupBy(seq_id).agg(
        F.coalesce(F.avg(kept), F.lit(0.0)).alias("logprob"),
        F.count(kept).alias("token_count"),
    )


def similarity_logprob(df: DataFrame, continuation: str, generated: str, alias: str) -> DataFrame:
    """Stand-in log-probability from the similarity of expected and generated text."""
    ratio = pair_similarity(F.lower(F.col(continuation)), F.lower(F.col(generated)))
    return df.withColumn("_ratio", ratio).withColumn(alias, floored_log(F.col("_ratio"))).drop("_ratio")


def output_similarities(options: DataFrame, outputs: DataFrame, keys: tuple[str, ...] = ("response_id",)) -> DataFrame:
    """similarity of each output with each option of its item, beside both their keys.

    ``options``: (item_id, option_idx, option); ``outputs``: (item_id, keys,
    completion). The character pairs of either side are worked out once per row,
    before the join repeats it.
    """

    def paired(table: DataFrame, text: str, name: str, *columns: str) -> DataFrame:
        lowered = F.lower(F.col(text))
        return table.select("item_id", *columns, lowered.alias(name), character_pairs(lowered).alias(f"{name}_pairs"))

    met = paired(outputs, "completion", "said", *keys).join(paired(options, "option", "asked", "option_idx"), "item_id")
    share = share_of_pairs(F.col("said_pairs"), F.col("asked_pairs"), F.col("said") == F.col("asked"))
    return met.select("item_id", *keys, "option_idx", share.alias("similarity"))


def floored_log(similarity: Column) -> Column:
    """A similarity as a log-probability, never below that of the least similarity."""
    return F.ln(F.greatest(similarity, F.lit(config.MIN_SIMILARITY)))


def option_logprobs(df: DataFrame) -> DataFrame:
    """First usable of logprob, sim_logprob and the default, with its source."""
    return df.withColumn(
        "source",
        F.when(F.col("logprob").isNotNull(), "logprob")
        .when(F.col("sim_logprob").isNotNull(), "similarity")
        .otherwise("default"),
    ).withColumn(
        "logprob", F.coalesce("logprob", "sim_logprob", F.lit(config.DEFAULT_LOGPROB))
    ).drop("sim_logprob")


def option_perplexity(
    options: DataFrame, threshold: float = config.PERPLEXITY_THRESHOLD, baseline: str = "incorrect"
) -> DataFrame:
    """Likelihood of the correct option relative to the geometric mean of the others.

    ``options``: (item_id, option_idx, correct_idx, logprob). ``baseline="all"``
    puts the correct option into the mean too. Rows whose correct index is
    unknown give a null score and the reason.
    """
    is_correct = F.col("option_idx") == F.col("correct_idx")
    in_mean = F.lit(True) if baseline == "all" else ~is_correct
    per_item = options.groupBy("item_id").agg(
        F.max(F.when(is_correct, F.col("logprob"))).alias("correct_logprob"),
        F.coalesce(F.avg(F.when(in_mean, F.col("logprob"))), F.lit(0.0)).alias("other_logprob"),
    )
    score = F.when(F.col("other_logprob") == 0, F.lit(0.0)).otherwise(
        F.exp(F.col("correct_logprob") - F.col("other_logprob"))
    )
    known = F.col("correct_logprob").isNotNull()
    return (
        per_item.withColumn("memorization_score", F.when(known, score))
        .withColumn("is_memorized", F.col("memorization_score") > threshold)
        .withColumn("threshold", F.lit(threshold))
        .withColumn("error", F.when(~known, "correct option unknown"))
    )


def sequence_perplexity(
    tokens: DataFrame, *keys: str, denominator: str = "valid", text_tokens: str | None = None
) -> DataFrame:
    """Average log-probability, perplexity and counts per sequence.

    Tokens without a log-probability do not count; a sequence with none has
    average 0.0 and infinite perplexity. ``denominator="text_tokens"`` divides
    by the token count of the input text, in the column ``text_tokens``.
    """
    valid = F.count("logprob")
    divisor = valid if denominator == "valid" else F.max(text_tokens)
    usable = (valid > 0) & (divisor > 0)
    stats = tokens.groupBy(*keys).agg(
        F.when(usable, F.sum("logprob") / divisor).otherwise(F.lit(0.0)).alias("avg_logprob"),
        F.count("*").alias("token_count"),
        valid.alias("valid_count"),
        (~F.coalesce(usable, F.lit(False))).alias("is_infinite"),
    )
    return stats.withColumn("perplexity", perplexity(F.col("avg_logprob"), F.col("is_infinite")))


def perplexity(avg_logprob: Column, is_infinite: Column) -> Column:
    return F.when(is_infinite, F.lit(float("inf"))).otherwise(F.exp(-avg_logprob))


def progressive_perplexity(tokens: DataFrame, seq_id: str, with_prefix: bool = False) -> DataFrame:
    """Perplexity of every prefix of every sequence.

    ``with_prefix`` adds the prefix text, whose total size is quadratic in the
    sequence length; offered for short sequences only.
    """
    sums = running_sums(
        tokens,
        seq_id,
        "pos",
        {
            "_sum": F.coalesce("logprob", F.lit(0.0)),
            "_valid": F.col("logprob").isNotNull().cast("bigint"),
        },
    )
    rows = sums.select(
        *tokens.columns,
        (F.col("pos") + 1).alias("token_count"),
        F.when(F.col("_valid") > 0, F.col("_sum") / F.col("_valid"))
        .otherwise(F.lit(0.0))
        .alias("avg_logprob"),
        (F.col("_valid") == 0).alias("is_infinite"),
    ).withColumn("perplexity", perplexity(F.col("avg_logprob"), F.col("is_infinite")))
    if with_prefix:
        upto = Window.partitionBy(seq_id).orderBy("pos").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        rows = rows.withColumn("prefix_text", F.array_join(F.collect_list("token").over(upto), ""))
    return rows


def is_endless() -> Column:
    return F.col("perplexity") == float("inf")


def finite(value: str) -> Column:
    """The value of texts of finite perplexity, null for the others."""
    return F.when(~is_endless(), F.col(value))


def rank_by_perplexity(scored: DataFrame, text_id: str) -> DataFrame:
    """Lowest first; texts of infinite perplexity come last."""
    return scored.orderBy("perplexity", text_id)


def compare_perplexities(scored: DataFrame, text_id: str) -> DataFrame:
    """Count, mean, and the texts of lowest and highest perplexity.

    An infinite perplexity is the highest. The mean is that of the finite ones;
    ``infinite`` says how many it leaves out.
    """
    rank = F.struct("perplexity", text_id)
    summary = scored.agg(
        F.count("*").alias("texts"),
        F.count_if(is_endless()).alias("infinite"),
        F.min(rank).alias("_lowest"),
        F.max(rank).alias("_highest"),
        F.coalesce(F.avg(finite("perplexity")), F.lit(0.0)).alias("avg_perplexity"),
    )
    return summary.select(
        "texts",
        "infinite",
        F.col(f"_lowest.{text_id}").alias("lowest_id"),
        F.col("_lowest.perplexity").alias("lowest_perplexity"),
        F.col(f"_highest.{text_id}").alias("highest_id"),
        F.col("_highest.perplexity").alias("highest_perplexity"),
        "avg_perplexity",
    )


def perplexity_contrast(scored: DataFrame, known: str = "known", random: str = "random") -> DataFrame:
    """Average, minimum and maximum of two classes and the ratio of their averages.

    They are those of the finite perplexities; the infinite ones are counted.
    """
    columns = []
    for name, label in (("known", known), ("random", random)):
        of_class = F.col("category") == label
        value = F.when(of_class, finite("perplexity"))
        for function, short in ((F.avg, "avg"), (F.min, "min"), (F.max, "max")):
            columns.append(F.coalesce(function(value), F.lit(0.0)).alias(f"{name}_{short}"))
        columns.append(F.count_if(of_class & is_endless()).alias(f"{name}_infinite"))
    ratio = F.when(F.col("known_avg") > 0, F.col("random_avg") / F.col("known_avg"))
    return scored.agg(*columns).withColumn("contrast_ratio", F.coalesce(ratio, F.lit(0.0)))


def perplexity_by_category(scored: DataFrame) -> DataFrame:
    """Texts and tokens of each category; averages leave out what ``infinite`` counts."""
    return scored.groupBy("category").agg(
        F.count("*").alias("texts"),
        F.count_if(is_endless()).alias("infinite"),
        F.avg(finite("perplexity")).alias("avg_perplexity"),
        F.avg(finite("avg_logprob")).alias("avg_logprob"),
        F.sum("token_count").alias("token_count"),
    )


def ratio_verdict(
    scored: DataFrame,
    references: DataFrame | None = None,
    threshold: float = config.ABSOLUTE_PERPLEXITY_THRESHOLD,
) -> DataFrame:
    """Verdict by absolute perplexity, or by its ratio to the references' finite mean.

    A text of infinite perplexity is not memorized.
    """
    compared = F.col("perplexity")
    if references is not None:
        compared = compared / references.agg(F.avg(finite("perplexity"))).scalar()
    return (
        scored.withColumn("compared", compared)
        .withColumn("is_memorized", F.col("compared") < threshold)
        .withColumn("confidence", 1 - F.col("perplexity") / (2 * threshold))
    )


def _likeliest_first(alternatives: Column) -> Column:
    """Alternatives of one position by falling log-probability, then token."""
    keyed = F.transform(
        F.coalesce(alternatives, F.array()),
        lambda a: F.struct(
            (-a["logprob"]).alias("minus"), a["token"].alias("token"), a["logprob"].alias("lp")
        ),
    )
    return F.array_sort(keyed)


def ranked_alternatives(tokens: DataFrame, seq_id: str) -> DataFrame:
    """Alternatives of each position, likeliest first.

    A response lists a handful of alternatives per position, so they are ranked
    inside the row.
    """
    ordered = _likeliest_first(F.col("top_logprobs"))
    return tokens.select(seq_id, "pos", F.posexplode(ordered).alias("_rank", "_a")).select(
        seq_id,
        "pos",
        (F.col("_rank") + 1).alias("rank"),
        F.col("_a.token").alias("alternative"),
        F.col("_a.lp").alias("logprob"),
    )


def temperature_top_p(
    tokens: DataFrame, seq_id: str, temperature: float = 1.0, top_p: float = 1.0
) -> DataFrame:
    """Softmax of log-probabilities over the temperature, cut to the nucleus.

    The nucleus keeps alternatives, likeliest first, until their mass reaches
    ``top_p``; what is kept is scaled back to one. At temperature 0 only the
    likeliest is kept. A position's alternatives share a row, so nothing is
    shuffled, and one pass over them in order gives the nucleus.
    """

    def weight(a: Column, best: Column) -> Column:
        if temperature == 0:
            return F.when(a == best, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.exp((a["lp"] - best["lp"]) / temperature)

    def weighed(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda a: F.struct(a["token"].alias("token"), weight(a, F.get(ordered, F.lit(0))).alias("w")),
        )

    def nucleus(items: Column) -> Column:
        mass = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["w"])
        empty = F.filter(items, lambda x: F.lit(False))
        start = F.struct(F.lit(0.0).alias("before"), mass.alias("mass"), empty.alias("kept"))

        def step(state: Column, item: Column) -> Column:
            is_in = F.round(state["before"] / state["mass"], 9) < top_p
            kept = F.when(is_in, F.array_append(state["kept"], item)).otherwise(state["kept"])
            return F.struct((state["before"] + item["w"]).alias("before"), state["mass"].alias("mass"), kept.alias("kept"))

        return F.aggregate(items, start, step)

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    cut = once(_likeliest_first(F.col("top_logprobs")), lambda ordered: once(weighed(ordered), nucleus))
    staged = tokens.select(seq_id, "pos", cut.alias("_n"))
    kept_mass = F.aggregate("_n.kept", F.lit(0.0), lambda acc, x: acc + x["w"])
    rows = staged.select(
        seq_id, "pos", F.col("_n.mass").alias("_mass"), kept_mass.alias("_kept_mass"), F.posexplode_outer("_n.kept").alias("_i", "_a")
    )
    return rows.where(F.col("_i").isNotNull()).select(
        seq_id,
        "pos",
        (F.col("_i") + 1).alias("rank"),
        F.col("_a.token").alias("alternative"),
        (F.col("_a.w") / F.col("_mass")).alias("probability"),
        (F.col("_a.w") / F.col("_kept_mass")).alias("nucleus_probability"),
    )


def perplexity_outliers(
    scored: DataFrame, reference: str, cutoff: float = 2.0
) -> DataFrame:
    """z-score of the log-perplexity against a class of known unseen texts.

    A text of infinite perplexity has no score and is no outlier on the low side.
    """
    logs = scored.withColumn("_log", -finite("avg_logprob"))
    known = logs.where(F.col("category") == reference)
    stats = known.agg(
        F.struct(F.avg("_log").alias("mean"), F.stddev_pop("_log").alias("sd")).alias("s")
    ).scalar()
    judged = logs.withColumn("_s", stats)
    return (
        judged.withColumn(
            "z_score",
            F.when(F.col("_s.sd") > 0, (F.col("_log") - F.col("_s.mean")) / F.col("_s.sd"))
            .otherwise(F.when(F.col("_log").isNotNull(), F.lit(0.0))),
        )
        .withColumn("is_outlier", F.coalesce(F.col("z_score") < -cutoff, F.lit(False)))
        .drop("_s", "_log")
    )


def contrast_significance(scored: DataFrame, left: str, right: str) -> DataFrame:
    """Welch's t, its degrees of freedom and two-sided p for the log-perplexity of two classes.

    All are null where neither class varies or one has fewer than two finite
    texts; infinite perplexities are counted beside.
    """
    columns = []
    for name, label in (("left", left), ("right", right)):
        of_class = F.col("category") == label
        value = F.when(of_class, -finite("avg_logprob"))
        columns += [
            F.count(value).alias(f"n_{name}"),
            F.count_if(of_class & is_endless()).alias(f"infinite_{name}"),
            F.avg(value).alias(f"mean_{name}"),
            F.var_samp(value).alias(f"var_{name}"),
        ]
    a = F.try_divide("var_left", "n_left")
    b = F.try_divide("var_right", "n_right")
    spread = a * F.try_divide(a, F.col("n_left") - 1) + b * F.try_divide(b, F.col("n_right") - 1)
    return (
        scored.agg(*columns)
        .withColumn("t_value", F.try_divide(F.col("mean_right") - F.col("mean_left"), F.sqrt(a + b)))
        .withColumn("degrees", F.try_divide((a + b) ** 2, spread))
        .withColumn("p_value", two_sided_p(F.col("t_value"), F.col("degrees")))
    )

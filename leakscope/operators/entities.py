"""Entity probes, recall, rarity and mention filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.similarity import held
from leakscope.functions.text import explode_rows
from leakscope.operators.scaling import lookup_join, probably_in
from leakscope.session import stored

# Characters of the grams by which words are looked up.
INDEX_GRAM = 3
WORDS_AND_GAPS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def entity_probes(
    entities: DataFrame, templates: tuple[str, ...] = config.ENTITY_TEMPLATES
) -> DataFrame:
    """Every entity in every template; the template list is part of the row."""
    probes = F.array(*[F.lit(t) for t in templates])
    return entities.select("entity", F.explode(probes).alias("template")).withColumn(
        "prompt", F.replace(F.col("template"), F.lit("{entity}"), F.col("entity"))
    )


def add_entities(entities: DataFrame, more: DataFrame) -> DataFrame:
    return entities.unionByName(more)


def truth_key(template: Column) -> Column:
    """Text of a template before the entity."""
    return F.trim(F.substring_index(template, "{entity}", 1))


def entity_hits(completions: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether each completion holds the expected text, ignoring case.

    ``completions``: (entity, template, completion); ``truth``: (entity, key,
    expected). A probe without known truth is not correct.
    """
    probes = completions.withColumn("key", truth_key(F.col("template")))
    found = F.contains(F.lower("completion"), F.lower("expected"))
    return probes.join(truth, ["entity", "key"], "left").withColumn(
        "is_correct", F.coalesce(found, F.lit(False))
    )


def entity_score(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """Share of correct probes per entity, 0.0 for entities without probes."""
    shares = hits.groupBy("entity").agg(
        F.count("*").alias("probes"), F.avg(F.col("is_correct").cast("double")).alias("score")
    )
    return (
        entities.select("entity").distinct()
        .join(shares, "entity", "left")
        .select(
            "entity",
            F.coalesce("probes", F.lit(0)).alias("probes"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def entity_occurrences(entities: DataFrame, corpus: DataFrame, text: str) -> DataFrame:
    """Whole-word occurrences of entities of any number of words, case-sensitive.

    A text is cut into words and the gaps between them; an entity is a run of such
    pieces, so counting is an equality join. Only runs of lengths that entities have
    are made, and a filter of fixed size leaves out nearly all that are none. The others
    are counted before the join, combined per task, so a frequent one costs a row per task.
    """
    listed = entities.select("entity").distinct()
    spans = listed.agg(
        F.array_sort(F.collect_set(F.size(F.regexp_extract_all("entity", F.lit(WORDS_AND_GAPS), F.lit(0)))))
    ).scalar()
    stored_pieces = corpus.select(
        F.regexp_extract_all(F.col(text), F.lit(WORDS_AND_GAPS), F.lit(0)).alias("_pieces"), spans.alias("_spans")
    )
    fitting = F.filter("_spans", lambda n: (n > 0) & (n <= F.size("_pieces")))
    runs = F.flatten(
        F.transform(
            fitting,
            lambda n: F.when(n == 1, F.col("_pieces")).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.size("_pieces") - n + 1),
                    lambda i: F.array_join(F.slice(F.col("_pieces"), i, n), ""),
                )
            ),
        )
    )
    asked = probably_in(listed, "entity")(F.col("entity"))
    counted = explode_rows(stored_pieces, runs, "entity").where(asked).groupBy("entity").agg(F.count("*").alias("occurrences"))
    return counted.join(listed, "entity", "left_semi")


def entity_rarity(entities: DataFrame, corpus: DataFrame, text: str) -> DataFrame:
    """-ln(max(occurrences, 1) / words of the corpus) per entity."""
    counts = entity_occurrences(entities, corpus, text)
    total = corpus.agg(F.sum(F.regexp_count(F.col(text), F.lit(r"\S+")).cast("bigint"))).scalar()
    seen = F.coalesce("occurrences", F.lit(0))
    return (
        entities.select("entity").distinct()
        .join(counts, "entity", "left")
        .select(
            "entity",
            seen.alias("occurrences"),
            (-F.ln(F.greatest(seen, F.lit(1)) / total)).alias("rarity"),
        )
    )


def _grams(word: Column, size: int) -> Column:
    """Distinct runs of so many characters; the word is cut into characters once."""

    def runs(chars: Column) -> Column:
        count = F.size(chars) - (size - 1)
        built = F.slice(chars, 1, count)
        for k in range(1, size):
            built = F.zip_with(built, F.slice(chars, k + 1, count), lambda a, b: F.concat(a, b))
        return F.array_distinct(built)

    chars = F.slice(F.split(word, ""), 1, F.length(word))
    return F.when(F.length(word) >= size, held(chars, runs)).otherwise(F.array().cast("array<string>"))


def _all_grams(words: DataFrame, word: str, *columns: str) -> DataFrame:
    """(columns, gram): what an index of the words looks its grams up by, up to INDEX_GRAM characters."""
    sizes = [_grams(F.col(word), size) for size in range(1, INDEX_GRAM + 1)]
    return explode_rows(words, F.concat(*sizes), "gram", *columns)


def entity_words(entities: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, entity, is_whole): words of the vocabulary that hold the entity's rarest part.

    ``vocabulary``: (word, occurrences). An entity is cut into its words, or taken
    whole if it has none; each lies within one word or gap of a text that names it.
    Of the grams of these parts, INDEX_GRAM characters or the part itself if it is
    shorter, the one in the fewest texts is the entity's key. An inverted index of the
    vocabulary's grams gives the words that hold the key, and those that hold the part
    are the result. An entity with a gram that no word holds occurs nowhere.
    """
    parts = F.regexp_extract_all(F.col("entity"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    listed = entities.where("entity <> ''").select("entity").distinct()
    cut = listed.select("entity", F.explode(F.when(F.size(parts) > 0, F.array_distinct(parts)).otherwise(F.array("entity"))).alias("part"))
    size = F.least(F.length("part"), F.lit(INDEX_GRAM))
    of_size = F.lit(None).cast("array<string>")
    for n in range(1, INDEX_GRAM + 1):
        of_size = F.when(size == n, _grams(F.col("part"), n)).otherwise(of_size)
    wanted = explode_rows(cut, of_size, "gram", "entity", "part")
    index = stored(
        _all_grams(vocabulary, "word", "word", "occurrences").join(wanted.select("gram").distinct(), "gram", "left_semi"),
        "gram-index",
    )
    frequency = index.groupBy("gram").agg(F.sum("occurrences").alias("texts"))
    weighed = wanted.join(frequency, "gram", "left")
    key = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram", "part")).alias("key")
    keys = weighed.groupBy("entity").agg(key).where("key.texts > 0").select("entity", "key.gram", "key.part")
    met = index.join(keys, "gram").where(F.contains(F.col("word"), F.col("part")))
    return met.select("word", "entity", (F.col("entity") == F.col("part")).alias("is_whole"))


def texts_with_entities(
    texts: DataFrame, entities: DataFrame, text_id: str, text: str
) -> DataFrame:
    """Texts that contain at least one listed entity as a substring.

    The distinct words and gaps of the corpus are indexed by their grams, and each
    entity meets only the words that hold its rarest one (:func:`entity_words`). Texts
    with a word that holds a whole entity are sure; for the others each pair of a text
    and an entity is a row, checked against the text. No text is compared with every
    entity. An empty entity names nothing.
    """
    cut = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(WORDS_AND_GAPS), F.lit(0)))
    words = explode_rows(texts.select(text_id, cut.alias("_w")), F.col("_w"), "word", text_id)
    vocabulary = stored(words.groupBy("word").agg(F.count("*").alias("occurrences")), "vocabulary")
    matched = stored(entity_words(entities, vocabulary), "entity-words")
    marked = matched.groupBy("word").agg(F.max("is_whole").alias("sure")).join(vocabulary, "word")
    hits = lookup_join(words, marked, ["word"], "occurrences", text_id).where("sure IS NOT NULL")
    hits = stored(hits, "entity-hits")
    sure = hits.where("sure").select(text_id).distinct()
    open_words = hits.where("NOT sure").select(text_id, "word").join(sure, text_id, "left_anti")
    pairs = open_words.join(matched.where("NOT is_whole").select("word", "entity"), "word").select(text_id, "entity")
    checked = (
        texts.select(text_id, text)
        .join(pairs.distinct(), text_id)
        .where(F.contains(F.col(text), F.col("entity")))
        .select(text_id)
    )
    return texts.join(sure.unionByName(checked), text_id, "left_semi")


def score_by_rarity(scores: DataFrame, rarity: DataFrame) -> DataFrame:
    """Mean recall of entities of like rarity, in steps of one nat."""
    joined = scores.join(rarity.select("entity", "rarity"), "entity")
    return joined.groupBy(F.floor("rarity").alias("rarity_band")).agg(
        F.count("*").alias("entities"), F.avg("score").alias("avg_score")
    )

"""Plain SQL for the registered queries, written apart from the Spark plans.

``WITH`` fragments are named in FRAGMENTS; ``compose`` puts the ones a statement
needs in front of it.
"""

from __future__ import annotations

import re

from leakscope import config

WORD = r"[\p{L}\p{N}]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _pick(choices, *parts: str) -> str:
    key = f"md5(concat_ws('|', {', '.join(parts)}))"
    return f"(('0x' || substr({key}, 1, 8))::BIGINT % {choices})"


def _letter(index: str) -> str:
    return f"chr(65 + ({index})::INTEGER)"


def _lettered(options: str) -> str:
    line = f"chr(64 + i::INTEGER) || '. ' || {options}[i] || chr(10)"
    return f"array_to_string([{line} for i in range(1, len({options}) + 1)], '')"


def _prompt(question: str, options: str) -> str:
    return (
        f"('Question: ' || {question} || chr(10) || chr(10) || 'Options:' || chr(10) || "
        f"{_lettered(options)} || chr(10) || 'Answer:')"
    )


def _open_prompt(question: str, options: str, request: str) -> str:
    lines = " || chr(10) || ".join(_text(part) for part in request.split("\n"))
    return (
        f"('Question: ' || {question} || chr(10) || chr(10) || 'Options:' || chr(10) || "
        f"{_lettered(options)} || chr(10) || chr(10) || {lines})"
    )


def _answer_letter(text: str) -> str:
    return (
        f"CASE WHEN regexp_extract({text}, '([A-D])[.\\s]', 1) <> '' "
        f"THEN regexp_extract({text}, '([A-D])[.\\s]', 1) "
        f"ELSE regexp_extract({text}, '[A-D]', 0) END"
    )


def _grams(tokens: str, n: int) -> str:
    return (
        f"list_distinct([array_to_string({tokens}[i:i + {n - 1}], ' ') "
        f"for i in range(1, len({tokens}) - {n - 2})])"
    )


def _gram_rows(key: str, table: str, n: int) -> str:
    """(key, gram) for the distinct n-grams of a table with a word list ``t``."""
    shifted = ", ".join(f"unnest(t[{i}:]) AS w{i}" for i in range(1, n + 1))
    words = ", ".join(f"w{i}" for i in range(1, n + 1))
    return (
        f"SELECT DISTINCT {key}, concat_ws(' ', {words}) AS gram "
        f"FROM (SELECT {key}, {shifted} FROM {table}) WHERE w{n} IS NOT NULL"
    )


def _rule(token: str) -> str:
    return (
        f"CASE WHEN lower({token}) IN {_in(config.COMMON_WORDS)} "
        f"THEN {config.COMMON_LOGPROB}::DOUBLE ELSE {config.OTHER_LOGPROB}::DOUBLE END"
    )


def _pairs(text: str) -> str:
    return f"list_distinct([substr({text}, i, 2) for i in range(1, length({text}))])"


def _pair_similarity(a: str, b: str) -> str:
    x, y = _pairs(a), _pairs(b)
    return (
        f"CASE WHEN len({x}) + len({y}) > 0 THEN 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) "
        f"ELSE ({a} = {b})::INTEGER END"
    )


def _ws(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '\\S+')"


def _jaccard(a: str, b: str, n: int) -> str:
    x, y = _grams(a, n), _grams(b, n)
    union = f"len(list_distinct(list_concat({x}, {y})))"
    both = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN {union} > 0 THEN {both}::DOUBLE / {union} ELSE 0.0 END"


def _weighted_jaccard(a: str, b: str) -> str:
    parts = [f"{w} * ({_jaccard(a, b, n)})" for n, w in enumerate(config.JACCARD_WEIGHTS, 1)]
    return " + ".join(parts)


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

FRAGMENTS: dict[str, str] = {
    # questions
    "halves": f"""
        SELECT item_id, t[1:len(t) // 2] AS stem, t[len(t) // 2 + 1:] AS rest
        FROM (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM benchmark)""",
    "option_rows": """
        SELECT a.item_id, o, coalesce(array_to_string(b.rest, ' '), '') AS option
        FROM halves a CROSS JOIN range(0, 4) r(o)
        LEFT JOIN halves b ON b.item_id =
            (a.item_id + (o - a.item_id % 4 + 4) % 4) % (SELECT max(item_id) + 1 FROM benchmark)""",
    "mcq": """
        SELECT h.item_id, array_to_string(stem, ' ') AS question, options, h.item_id % 4 AS correct_idx,
               stem[-1] AS last_word, array_to_string(rest, ' ') AS continuation
        FROM halves h JOIN (SELECT item_id, list(option ORDER BY o) AS options
                            FROM option_rows GROUP BY item_id) USING (item_id)""",
    "raw_questions": f"""
        SELECT 'q' || item_id AS id, item_id, question, options, correct_idx,
            {_pick(4, "item_id", "'answer'")} AS kind,
            CASE WHEN item_id % 2 = 0 THEN {_letter("correct_idx")}
                 WHEN {_pick(4, "item_id", "'answer'")} = 0 THEN continuation
                 WHEN {_pick(4, "item_id", "'answer'")} = 1
                    THEN ' ' || chr(9) || upper(continuation) || chr(10)
                 WHEN {_pick(4, "item_id", "'answer'")} = 2
                    THEN substr(continuation, 1, length(continuation) - 1)
                 ELSE 'no such answer' END AS answer,
            CASE WHEN {_pick(10, "item_id", "'split'")} < 8 THEN 'train'
                 WHEN {_pick(10, "item_id", "'split'")} = 8 THEN 'validation'
                 ELSE 'test' END AS split
        FROM mcq""",
    # completions
    "turns_of_items": """
        SELECT conv_id % (SELECT max(item_id) + 1 FROM benchmark) AS item_id,
               conv_id || '-' || turn AS response_id, coalesce(text, '') AS reply
        FROM conversations WHERE role = 'assistant'""",
    "completions": f"""
        SELECT item_id, response_id,
            CASE WHEN kind IN (0, 2) THEN NULL WHEN kind = 1 THEN '' ELSE said END AS completion,
            CASE WHEN kind = 0 THEN 'no_choices' WHEN kind = 2 THEN 'malformed' END AS error
        FROM (
            SELECT t.item_id, response_id, {_pick(8, "t.item_id", "response_id", "'completion'")} AS kind,
                CASE WHEN {_pick(3, "response_id", "'leak'")} = 0
                     THEN 'Answer ' || {_letter("correct_idx")} || '. ' ||
                          array_to_string(string_split(continuation, ' ')
                              [1:len(string_split(continuation, ' ')) // 2], ' ') || ' ' || reply
                     ELSE reply END AS said
            FROM turns_of_items t JOIN mcq m ON m.item_id = t.item_id)""",
    "own_refs": """
        SELECT item_id, 0 AS ref_idx, question AS reference FROM mcq
        UNION ALL SELECT item_id, o + 1, option FROM option_rows""",
    "gram_overlaps": f"""
        SELECT item_id, response_id, ref_idx, n, len(found) AS output_count, len(reference) AS ref_count,
               len(list_intersect(found, reference)) AS overlap_count,
               CASE WHEN len(reference) > 0
                    THEN len(list_intersect(found, reference))::DOUBLE / len(reference) END AS ratio
        FROM (
            SELECT c.item_id, response_id, ref_idx, n,
                   list_distinct([array_to_string(f[i:i + n - 1], ' ')
                       for i in range(1, len(f) - n + 2)]) AS found,
                   list_distinct([array_to_string(g[i:i + n - 1], ' ')
                       for i in range(1, len(g) - n + 2)]) AS reference
            FROM (SELECT item_id, response_id, regexp_extract_all(lower(completion), '{WORD}') AS f
                  FROM completions WHERE error IS NULL) c
            JOIN (SELECT item_id, ref_idx, regexp_extract_all(lower(reference), '{WORD}') AS g
                  FROM own_refs) USING (item_id)
            CROSS JOIN (VALUES (2), (3), (4)) sizes(n))""",
    "by_size": """
        SELECT item_id, response_id, n, max(output_count) AS output_count, count(ratio) AS refs,
               coalesce(max(ratio), 0.0) AS best
        FROM gram_overlaps GROUP BY item_id, response_id, n""",
    "ngram_scores": """
        SELECT item_id, response_id, max(best) AS score, max(best) > 0.3 AS flag
        FROM by_size GROUP BY item_id, response_id""",
    # contamination
    "item_words": f"SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM benchmark",
    "item_grams": _gram_rows("item_id", "item_words", 8),
    "doc_grams": f"""
        SELECT doc_id, gram FROM ({_gram_rows("doc_id", "doc_words", 8)})
        WHERE gram IN (SELECT gram FROM item_grams)""",
    "contaminated": """
        SELECT item_id, doc_id, count(*) AS overlap_count, any_value(total) AS ref_count,
               count(*)::DOUBLE / any_value(total) AS containment
        FROM item_grams JOIN doc_grams USING (gram)
        JOIN (SELECT item_id, count(*) AS total FROM item_grams GROUP BY item_id) USING (item_id)
        GROUP BY item_id, doc_id
        HAVING count(*)::DOUBLE / any_value(total) > 0.3""",
    "leaks": "SELECT doc_id, max(containment) AS leak_score FROM contaminated GROUP BY doc_id",
    # language model of the documents
    "doc_words": f"SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents",
    "unigrams": """
        SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM doc_words) GROUP BY w""",
    "bigrams": """
        SELECT p, w, count(*) AS c
        FROM (SELECT unnest(t[1:len(t) - 1]) AS p, unnest(t[2:]) AS w FROM doc_words WHERE len(t) > 1)
        GROUP BY p, w""",
    "option_tokens": f"""
        SELECT r.item_id * 4 + o AS seq_id,
               list_concat([last_word], regexp_extract_all(option, '{WORD}')) AS t
        FROM option_rows r JOIN mcq USING (item_id)""",
    "option_scores": """
        SELECT seq_id // 4 AS item_id, seq_id % 4 AS option_idx, (seq_id // 4) % 4 AS correct_idx,
               avg(ln((coalesce(b.c, 0) + 1) / (coalesce(u.c, 0) + (SELECT count(*) FROM unigrams))))
                   AS logprob
        FROM (SELECT seq_id, unnest(t[1:len(t) - 1]) AS p, unnest(t[2:]) AS w
              FROM option_tokens WHERE len(t) > 1)
        LEFT JOIN bigrams b USING (p, w) LEFT JOIN unigrams u ON u.w = p
        GROUP BY seq_id""",
    "option_verdicts": """
        SELECT item_id, max(logprob) FILTER (option_idx = correct_idx) AS correct_logprob,
               avg(logprob) FILTER (option_idx <> correct_idx) AS other_logprob,
               exp(max(logprob) FILTER (option_idx = correct_idx)
                   - avg(logprob) FILTER (option_idx <> correct_idx)) AS score
        FROM option_scores GROUP BY item_id""",
    "texts": """
        SELECT 'b' || item_id AS text_id, 'known' AS category, '' AS lang, text FROM benchmark
        UNION ALL SELECT 'd' || doc_id, 'corpus', lang, text FROM documents
        UNION ALL SELECT 'r' || item_id, 'random', '', reverse(text) FROM benchmark
        UNION ALL SELECT 'c' || conv_id || '-' || turn, 'unseen', '', text FROM conversations""",
    "text_tokens": f"""
        SELECT text_id, i - 1 AS pos, t[i - 1] AS prev, t[i] AS token
        FROM (SELECT text_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM texts),
             unnest(range(1, len(t) + 1)) r(i)""",
    "text_scores": """
        SELECT text_id, pos, token,
               CASE WHEN pos > 0 THEN ln((coalesce(b.c, 0) + 1)
                   / (coalesce(u.c, 0) + (SELECT count(*) FROM unigrams))) END AS logprob
        FROM text_tokens s
        LEFT JOIN bigrams b ON b.p = s.prev AND b.w = s.token LEFT JOIN unigrams u ON u.w = s.prev""",
    "text_stats": """
        SELECT text_id, any_value(category) AS category, any_value(lang) AS lang,
               coalesce(avg(logprob), 0.0) AS avg_logprob, count(token) AS token_count,
               count(logprob) AS valid_count, count(logprob) = 0 AS is_infinite,
               exp(-avg(logprob)) AS perplexity
        FROM (SELECT text_id, category, lang FROM texts) LEFT JOIN text_scores USING (text_id)
        GROUP BY text_id""",
    # recorded replies
    "replies": """
        SELECT conv_id || '-' || turn AS response_id, regexp_extract_all(text, '\\s*\\S+') AS pieces
        FROM conversations WHERE role = 'assistant'""",
    "legacy": f"""
        SELECT response_id, pieces, list_concat(pieces, [' generated']) AS tokens,
               {_pick(10, "response_id", "'legacy'")} AS kind
        FROM replies""",
    "legacy_tokens": f"""
        SELECT response_id, i - 1 AS pos, tokens[i] AS token, len(pieces) AS pieces,
               length(array_to_string(pieces[1:len(pieces) // 2], '')) AS prompt_chars,
               CASE WHEN i = 1 AND len(pieces) > 0 THEN NULL WHEN i = len(tokens) THEN -5.0::DOUBLE
                    ELSE {_rule("tokens[i]")} END AS logprob
        FROM legacy, unnest(range(1, len(tokens) + 1)) r(i) WHERE kind > 3""",
    "chat_tokens": f"""
        SELECT response_id, i - 1 AS pos, pieces[i] AS token, {_rule("pieces[i]")} AS logprob
        FROM replies, unnest(range(1, len(pieces) + 1)) r(i)
        WHERE {_pick(10, "response_id", "'chat'")} > 3""",
    "alternatives": """
        SELECT response_id, pos, alternative, lp,
               row_number() OVER (PARTITION BY response_id, pos ORDER BY lp DESC, alternative) AS rank
        FROM (
            SELECT response_id, pos, token AS alternative, logprob AS lp FROM chat_tokens
            UNION ALL SELECT response_id, pos, 'the',
                logprob - 0.2::DOUBLE * ((pos + length(token)) % 5 + 1) FROM chat_tokens
            UNION ALL SELECT response_id, pos, 'of', logprob - 1.9::DOUBLE FROM chat_tokens)""",
    # vectors
    "vector_pairs": """
        SELECT a.vec_id AS item_id, b.vec_id AS ref_id,
               list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
        FROM embeddings a CROSS JOIN range(1, 5) r(d)
        JOIN embeddings b ON b.vec_id = (a.vec_id + d) % (SELECT max(vec_id) + 1 FROM embeddings)""",
    "vector_scores": """
        SELECT item_id, count(*) AS refs, max(similarity) AS score FROM vector_pairs GROUP BY item_id""",
    "doc_terms": """
        SELECT doc_id, term, count(*) AS tf
        FROM (SELECT doc_id, unnest(t) AS term FROM doc_words) GROUP BY doc_id, term""",
    "idf": """
        SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf
        FROM doc_terms GROUP BY term""",
    # consistency
    "originals": f"""
        SELECT item_id, options, correct_idx, answer_text, letter AS original_answer,
               CASE WHEN letter <> '' THEN ascii(letter) - 65
                    ELSE {_pick("len(options)", "item_id", "'arbitrary'")} END AS original_idx
        FROM (SELECT *, {_answer_letter("answer_text")} AS letter
              FROM (SELECT item_id, options, correct_idx,
                    CASE WHEN kind < 7 THEN {_letter("correct_idx")} || '. ' || options[correct_idx + 1]
                         WHEN kind = 7 THEN {_letter("(correct_idx + 1) % 4")} || '. ' ||
                                            options[(correct_idx + 1) % 4 + 1]
                         WHEN kind = 8 THEN 'Answer: ' || {_letter("correct_idx")}
                         ELSE 'I am not sure' END AS answer_text
                    FROM (SELECT *, {_pick(10, "item_id", "'original'")} AS kind FROM mcq)))""",
    "trial_orders": """
        SELECT item_id, trial,
               CASE WHEN shuffled = [0, 1, 2, 3] THEN [1, 2, 3, 0] ELSE shuffled END AS shuffled
        FROM (SELECT item_id, trial,
                     list(i ORDER BY md5(concat_ws('|', item_id, trial, i)), i) AS shuffled
              FROM mcq CROSS JOIN range(1, 6) t(trial) CROSS JOIN range(0, 4) r(i)
              GROUP BY item_id, trial)""",
    "planned": f"""
        SELECT item_id, trial, question, options, correct_idx, shuffled,
               {_list(config.MODIFICATION_TYPES)}[{_pick(3, "item_id", "trial", "'type'")} + 1] AS kind,
               {_list(config.LEAD_INS)}[{_pick(5, "item_id", "trial", "'lead'")} + 1]
                   || lower(question) AS rephrased
        FROM mcq JOIN trial_orders USING (item_id)""",
    "shown": """
        SELECT *, [options[i + 1] for i in shown_order] AS options_shown
        FROM (SELECT *, CASE WHEN kind = 'rephrased' THEN [0, 1, 2, 3] ELSE shuffled END AS shown_order
              FROM planned)""",
    "trial_answers": f"""
        SELECT *, {_answer_letter("answer_text")} AS letter
        FROM (SELECT *,
                CASE WHEN draw < 6 THEN {_letter("place - 1")} || '. ' || options_shown[place]
                     WHEN draw < 9 THEN {_letter("place % 4")} || '. ' || options_shown[place % 4 + 1]
                     ELSE 'I am not sure' END AS answer_text
              FROM (SELECT *, list_position(shown_order, correct_idx) AS place,
                           {_pick(10, "item_id", "trial", "'reply'")} AS draw
                    FROM shown))""",
    "mapped": """
        SELECT item_id, trial, kind, letter,
               CASE WHEN letter = '' THEN -1
                    WHEN kind = 'rephrased' THEN ascii(letter) - 65
                    ELSE coalesce(list_max([j for j in range(0, 4)
                        if options[j + 1] = options_shown[ascii(letter) - 64]]), -1) END AS modified_idx
        FROM trial_answers""",
    "consistent": """
        SELECT item_id, count(*) AS trials, count_if(modified_idx = original_idx) AS consistent,
               avg((modified_idx = original_idx)::INTEGER) AS share,
               any_value(original_idx) = any_value(correct_idx) AS right_first
        FROM mapped JOIN originals USING (item_id) GROUP BY item_id""",
    "consistency_scores": """
        SELECT item_id, right_first, CASE WHEN right_first THEN 1.0 - share ELSE 0.0 END AS score,
               right_first AND share < 0.7 AS flag
        FROM consistent""",
    # combination
    "detections": """
        SELECT item_id, NULL::VARCHAR AS response_id, 'perplexity' AS method, score, score > 1.5 AS flag, NULL AS error
        FROM option_verdicts
        UNION ALL SELECT item_id, response_id, 'ngram', score, flag, error
        FROM completions LEFT JOIN ngram_scores USING (item_id, response_id)
        UNION ALL SELECT item_id, NULL, 'embedding', score, score > 0.35,
            CASE WHEN score IS NULL THEN 'no vector' END
        FROM mcq LEFT JOIN vector_scores USING (item_id)
        UNION ALL SELECT item_id, NULL, 'consistency', score, flag, NULL FROM consistency_scores""",
    "method_votes": """
        SELECT item_id, method, avg(score) AS score,
               CASE WHEN count(flag) > 0 THEN count_if(flag) * 2 >= count(flag) END AS flag,
               CASE WHEN count(error) = count(*) THEN min(error) END AS error,
               count(*) AS outputs, count(error) AS failed
        FROM detections GROUP BY item_id, method""",
    "strongest": """
        SELECT item_id, arg_max(response_id, struct_pack(s := score, r := response_id)) AS shown
        FROM ngram_scores GROUP BY item_id""",
    "details": """
        SELECT item_id, 'perplexity' AS method, count(*) AS detail_entries, sum(logprob) AS total,
               avg(logprob) FILTER (option_idx <> correct_idx) AS baseline, NULL::VARCHAR AS answers,
               NULL::VARCHAR AS shown, 1 AS kept_details
        FROM option_scores GROUP BY item_id
        UNION ALL SELECT item_id, 'ngram', count(*) FILTER (response_id = shown),
               sum(best) FILTER (response_id = shown), NULL, NULL, any_value(shown), count(DISTINCT response_id)
        FROM by_size JOIN strongest USING (item_id) GROUP BY item_id
        UNION ALL SELECT item_id, 'embedding', count(*), sum(similarity), NULL, NULL, NULL, 1
        FROM vector_pairs GROUP BY item_id
        UNION ALL SELECT item_id, 'consistency', count(*), sum(modified_idx), NULL,
               string_agg(letter, ',' ORDER BY trial), NULL, 1
        FROM mapped GROUP BY item_id""",
    "verdicts": """
        SELECT m.item_id, m.question, coalesce(avg(score), 0.0) AS score,
               count_if(flag) * 2 >= count(flag) AND count(flag) > 0 AS flag
        FROM mcq m LEFT JOIN method_votes d ON d.item_id = m.item_id
        GROUP BY m.item_id, m.question""",
    # entities
    "cased": f"SELECT doc_id, regexp_extract_all(text, '{WORD}') AS t FROM documents",
    "entities": """
        SELECT entity FROM (
            SELECT entity, count(*) AS n
            FROM (SELECT doc_id, unnest(list_distinct(t)) AS entity FROM cased)
            WHERE regexp_full_match(entity, '[A-Z][a-z]{4,}') GROUP BY entity)
        WHERE n >= (SELECT count(*) FROM documents) * 0.02
        UNION ALL SELECT r_name FROM region""",
    "followers": """
        SELECT entity, arg_max(follower, struct_pack(n := n, f := follower)) AS follower
        FROM (SELECT entity, follower, count(*) AS n
              FROM (SELECT unnest(t[1:len(t) - 1]) AS entity, unnest(t[2:]) AS follower
                    FROM cased WHERE len(t) > 1)
              WHERE entity IN (SELECT entity FROM entities) GROUP BY entity, follower)
        GROUP BY entity""",
    "probes": f"""
        SELECT entity, template, replace(template, '{{entity}}', entity) AS prompt
        FROM entities CROSS JOIN (SELECT unnest({_list(config.ENTITY_TEMPLATES)}) AS template)""",
    "probe_hits": f"""
        SELECT entity, template, completion,
               coalesce(contains(lower(completion), lower(follower)), false) AS is_correct
        FROM (SELECT entity, template, follower,
                CASE WHEN follower IS NULL OR kind = 1 THEN 'unknown'
                     WHEN kind = 0 THEN 'It is ' || upper(follower)
                     ELSE follower || ' indeed' END AS completion
              FROM (SELECT *, {_pick(3, "entity", "template")} AS kind
                    FROM probes LEFT JOIN followers USING (entity)))""",
    "entity_scores": """
        SELECT entity, count(*) AS probes, avg(is_correct::INTEGER) AS score
        FROM probe_hits GROUP BY entity""",
    "rarity": """
        SELECT e.entity, coalesce(n, 0) AS occurrences,
               -ln(greatest(coalesce(n, 0), 1)
                   / (SELECT sum(len(regexp_extract_all(text, '\\S+'))) FROM documents)) AS rarity
        FROM (SELECT DISTINCT entity FROM entities) e
        LEFT JOIN (SELECT w AS entity, count(*) AS n
                   FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents)
                   GROUP BY w) USING (entity)""",
    # tables
    "row_lines": """
        SELECT p_partkey AS row_id, column_name, actual,
               ('0x' || substr(md5(concat_ws('|', p_partkey, column_name)), 1, 8))::BIGINT % 5 AS kind
        FROM (SELECT p_partkey, 'p_type' AS column_name, p_type AS actual FROM part
              UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part
              UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice::VARCHAR FROM part)""",
    "row_values": """
        SELECT row_id, column_name, actual,
               CASE kind WHEN 1 THEN 'zzz' WHEN 2 THEN actual || ' x' ELSE actual END AS predicted
        FROM row_lines WHERE kind > 0""",
    "row_matches": """
        SELECT *, contains(lower(predicted), lower(actual))
                  OR contains(lower(actual), lower(predicted)) AS is_match
        FROM row_values""",
    # duplicates
    "copies": f"""
        SELECT doc_id, lang, n_chars,
               md5(regexp_replace(trim(lower(text), {SPACES}), '\\s+', ' ', 'g')) AS text_key
        FROM documents""",
}


def _solved(sums: str, size: int, step: int) -> dict[str, str]:
    """Fragments that bring the equations ``m{row}{column}`` of one row to the diagonal."""
    found, before = {}, sums
    for k in range(size):
        cells = []
        for i in range(size):
            for j in range(size + 1):
                top = f"m{k}{j} / m{k}{k}"
                cells.append((top if i == k else f"m{i}{j} - m{i}{k} * ({top})") + f" AS m{i}{j}")
        before, old = f"member_pivot{step}_{k}", before
        found[before] = f"SELECT {', '.join(cells)} FROM {old}"
    return found


def _member_fit(features: list[str], steps: int, ridge: float) -> dict[str, str]:
    """Steps of a logistic fit of ``y`` in member_features, from zero; the last gives member_fit."""
    size = len(features) + 1
    scaled = ", ".join(
        f"CASE WHEN sd{i} > 0 THEN ({f} - mean{i}) / sd{i} ELSE 0.0 END AS x{i}" for i, f in enumerate(features, 1)
    )
    moments = ", ".join(f"avg({f}) AS mean{i}, stddev_pop({f}) AS sd{i}" for i, f in enumerate(features, 1))
    eta = " + ".join(f"b{i} * x{i}" for i in range(size))
    found = {
        "member_moments": f"SELECT {moments} FROM member_features",
        "member_inputs": f"SELECT text_id, y, 1.0::DOUBLE AS x0, {scaled} FROM member_features, member_moments",
        "member_weights0": "SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(size)),
    }
    for step in range(1, steps + 1):
        cells = []
        for i in range(size):
            for j in range(size):
                own = f" + {ridge}" if i == j else ""
                cells.append(f"sum(p * (1 - p) * x{i} * x{j}){own} AS m{i}{j}")
            cells.append(f"sum((y - p) * x{i}) - {ridge} * any_value(b{i}) AS m{i}{size}")
        found[f"member_sums{step}"] = (
            f"SELECT {', '.join(cells)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p "
            f"FROM member_inputs, member_weights{step - 1})"
        )
        found |= _solved(f"member_sums{step}", size, step)
        new = ", ".join(f"b{i} + m{i}{size} AS b{i}" for i in range(size))
        found[f"member_weights{step}"] = (
            f"SELECT {new} FROM member_weights{step - 1}, member_pivot{step}_{size - 1}"
        )
    found["member_fit"] = (
        f"SELECT text_id, y, 1 / (1 + exp(-({eta}))) AS p FROM member_inputs, member_weights{steps}"
    )
    return found


FRAGMENTS |= {
    "member_words": f"""
        SELECT text_id, regexp_extract_all(lower(text), '{WORD}') AS t
        FROM texts WHERE category IN ('corpus', 'unseen')""",
    "member_grams": _gram_rows("text_id", "member_words", 8),
    "member_leaks": """
        SELECT text_id, max(c) AS leak
        FROM (SELECT item_id, text_id, count(*)::DOUBLE / any_value(total) AS c
              FROM item_grams JOIN member_grams USING (gram)
              JOIN (SELECT item_id, count(*) AS total FROM item_grams GROUP BY item_id) USING (item_id)
              GROUP BY item_id, text_id)
        WHERE c > 0.3 GROUP BY text_id""",
    "member_features": """
        SELECT text_id, (category = 'corpus')::INTEGER AS y, avg_logprob AS lp,
               coalesce(leak, 0.0) AS leak, ln(1 + token_count) AS tokens
        FROM text_stats LEFT JOIN member_leaks USING (text_id)
        WHERE category IN ('corpus', 'unseen')""",
} | _member_fit(["lp", "leak", "tokens"], 8, 1.0)


def compose(statement: str) -> str:
    """The statement behind a WITH clause of the fragments it needs."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in FRAGMENTS:
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s*\(?{name}\b", sql):
                visit(FRAGMENTS[name])
                if name not in needed:
                    needed.append(name)

    visit(statement)
    if not needed:
        return statement.strip()
    return "WITH " + ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in needed) + statement


def _entropy(table: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS distinct_values, "
        f"round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS entropy "
        f"FROM (SELECT {c}, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "o_orderdate",
    "o_orderpriority",
]

ALTERED = """
    SELECT item_id, trial, array_to_string({shown}, ' | ') AS options_shown, {prompt} AS prompt
    FROM planned"""

SHUFFLED = "[options[i + 1] for i in shuffled]"


def _chat_json(prompt: str, temperature: float, tokens: int) -> str:
    return (
        f"json_object('model', 'example-model', 'messages', json_array(json_object("
        f"'role', 'user', 'content', {prompt})), 'temperature', {temperature}::DOUBLE, "
        f"'max_tokens', {tokens})::VARCHAR"
    )


def _trial_prompt(shown: str) -> str:
    return _prompt("CASE WHEN kind = 'reordered' THEN question ELSE rephrased END", shown)


SIMILAR = f"""
    SELECT item_id, response_id, o, {_pair_similarity("a", "b")} AS similarity
    FROM (SELECT item_id, response_id, o, lower(option) AS a, lower(completion) AS b
          FROM option_rows JOIN completions USING (item_id) WHERE error IS NULL)"""

STATEMENTS: dict[str, str] = {
    "load_questions": """
        SELECT id, question, options[2] AS option_b, answer, split
        FROM raw_questions WHERE split = 'train'""",
    "preprocess_questions": f"""
        SELECT id, question, array_to_string(options, ' | ') AS options,
               {_prompt("question", "options")} AS formatted_prompt, answer AS correct_answer,
               CASE WHEN item_id % 2 = 0 OR kind < 3 THEN correct_idx ELSE -1 END AS correct_idx
        FROM raw_questions""",
    "result_documents": """
        SELECT 'q' || d.item_id AS id, d.method, CASE WHEN error IS NULL
                   THEN round(d.score, 6) + 0.0 END AS memorization_score,
               CASE WHEN error IS NULL AND d.flag THEN 'true' WHEN error IS NULL THEN 'false'
                    ELSE 'none' END AS is_memorized, error, outputs, failed,
               detail_entries, round(x.total, 6) + 0.0 AS detail_total,
               round(x.baseline, 6) + 0.0 AS detail_baseline, x.answers AS detail_answers, shown,
               round(v.score, 6) + 0.0 AS aggregate_score, v.flag AS verdict
        FROM method_votes d JOIN verdicts v ON v.item_id = d.item_id
        LEFT JOIN details x ON x.item_id = d.item_id AND x.method = d.method""",
    "results_roundtrip": """
        SELECT 'q' || d.item_id AS id, d.method, CASE WHEN error IS NULL
                   THEN round(d.score, 6) + 0.0 END AS memorization_score,
               CASE WHEN error IS NULL AND d.flag THEN 'true' WHEN error IS NULL THEN 'false'
                    ELSE 'none' END AS is_memorized,
               CASE WHEN error IS NULL THEN round(d.score, 6) + 0.0 END AS rescored, outputs, failed,
               detail_entries, round(x.total, 6) + 0.0 AS detail_total,
               round(x.baseline, 6) + 0.0 AS detail_baseline, x.answers AS detail_answers, shown, kept_details,
               round(v.score, 6) + 0.0 AS aggregate_score, v.flag AS verdict,
               CASE d.method WHEN 'perplexity' THEN 1.5::DOUBLE WHEN 'ngram' THEN 0.3::DOUBLE
                           WHEN 'embedding' THEN 0.35::DOUBLE ELSE 0.7::DOUBLE END AS threshold,
               'example-model' AS model, (SELECT count(*) FROM mcq) AS num_examples, 4::BIGINT AS n_methods
        FROM method_votes d JOIN verdicts v ON v.item_id = d.item_id
        LEFT JOIN details x ON x.item_id = d.item_id AND x.method = d.method""",
    "chat_logprob_requests": """
        SELECT r.item_id, o AS part,
               json_object('model', 'example-model', 'messages', json_array(json_object(
                   'role', 'user', 'content', question || option)), 'max_tokens', 1,
                   'temperature', 0.0::DOUBLE, 'logprobs', true, 'top_logprobs', 5)::VARCHAR AS body
        FROM option_rows r JOIN mcq m ON m.item_id = r.item_id""",
    "request_table": f"""
        SELECT r.item_id, 'perplexity' AS method, o AS part,
               json_object('model', 'example-model', 'prompt', question || option,
                   'temperature', 0.0::DOUBLE, 'max_tokens', 1, 'logprobs', true,
                   'top_logprobs', 5, 'echo', true)::VARCHAR AS body
        FROM option_rows r JOIN mcq m ON m.item_id = r.item_id
        UNION ALL SELECT item_id, 'ngram', 0,
            {_chat_json(_open_prompt("question", "options", config.EXPLANATION_REQUEST), 0.7, 300)}
        FROM mcq
        UNION ALL SELECT item_id, 'embedding', 0,
            {_chat_json(_open_prompt("question", "options", config.STEPWISE_REQUEST), 0.7, 300)}
        FROM mcq
        UNION ALL SELECT item_id, 'consistency', 0,
            {_chat_json(_prompt("question", "options"), 0.1, 50)} FROM mcq
        UNION ALL SELECT item_id, 'consistency', trial,
            {_chat_json(_trial_prompt("options_shown"), 0.1, 50)} FROM shown""",
    "parse_completions": "SELECT item_id, response_id, completion, error FROM completions",
    "parse_logprobs_legacy": "SELECT response_id, pos, token, logprob FROM legacy_tokens",
    "parse_logprobs_chat": """
        SELECT response_id, pos, token, logprob, 3::BIGINT AS alternatives FROM chat_tokens""",
    "response_quarantine": """
        SELECT response_id,
               ['no_choices', 'no_logprobs', 'no_tokens', 'malformed'][kind + 1] AS error
        FROM legacy WHERE kind <= 3""",
    "format_prompt": f"SELECT item_id, {_prompt('question', 'options')} AS prompt FROM mcq",
    "method_prompts": f"""
        SELECT item_id,
            {_open_prompt("question", "options", config.EXPLANATION_REQUEST)} AS explanation_prompt,
            {_open_prompt("question", "options", config.STEPWISE_REQUEST)} AS stepwise_prompt
        FROM mcq""",
    "prompt_reordered": ALTERED.format(shown=SHUFFLED, prompt=_prompt("question", SHUFFLED)),
    "prompt_rephrased": ALTERED.format(shown="options", prompt=_prompt("rephrased", "options")),
    "prompt_both": ALTERED.format(shown=SHUFFLED, prompt=_prompt("rephrased", SHUFFLED)),
    "answer_index": """
        SELECT id, CASE WHEN item_id % 2 = 1 AND kind < 3 THEN correct_idx ELSE -1 END AS answer_idx
        FROM raw_questions""",
    "seeded_sample": """
        SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42|' || doc_id) LIMIT 100""",
    "selected_methods": """
        SELECT method, count(DISTINCT item_id) AS items, count(*) AS outputs, count(score) FILTER (error IS NULL) AS scored,
               count_if(flag AND error IS NULL) AS memorized
        FROM detections WHERE method IN ('ngram', 'consistency') GROUP BY method""",
    "detection_errors": """
        SELECT m.item_id, response_id, m.method, CASE WHEN score IS NULL AND error IS NULL THEN 'no result' ELSE error END AS error
        FROM (SELECT item_id, unnest(['perplexity', 'ngram', 'embedding', 'consistency']) AS method FROM mcq) m
        LEFT JOIN detections d ON d.item_id = m.item_id AND d.method = m.method
        WHERE error IS NOT NULL OR score IS NULL""",
    "text_preview": """
        SELECT doc_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS preview
        FROM documents""",
    "word_tokens": """
        SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens,
               md5(array_to_string(t, ' ')) AS digest
        FROM doc_words""",
    "ngram_sets": f"""
        SELECT doc_id, coalesce(g2, 0) AS grams_2, coalesce(g3, 0) AS grams_3, coalesce(g4, 0) AS grams_4
        FROM documents
        {" ".join(
            f"LEFT JOIN (SELECT doc_id, count(*) AS g{n} FROM ({_gram_rows('doc_id', 'doc_words', n)}) "
            f"GROUP BY doc_id) USING (doc_id)" for n in (2, 3, 4)
        )}""",
    "ngram_overlap": """
        SELECT item_id, response_id, ref_idx, n::BIGINT AS n, overlap_count, ref_count,
               round(ratio, 6) + 0.0 AS overlap_ratio
        FROM gram_overlaps""",
    "ngram_by_size": """
        SELECT item_id, response_id, n::BIGINT AS n, output_count, refs AS "references",
               round(best, 6) + 0.0 AS max_overlap_ratio
        FROM by_size""",
    "ngram_verdict": """
        SELECT item_id, response_id, round(score, 6) + 0.0 AS memorization_score, flag AS is_memorized
        FROM ngram_scores""",
    "corpus_contamination": """
        SELECT item_id, doc_id, overlap_count, ref_count, round(containment, 6) + 0.0 AS containment
        FROM contaminated""",
    "weighted_jaccard": f"""
        SELECT conv_id, turn, round({_weighted_jaccard("a", "b")}, 6) + 0.0 AS similarity
        FROM (SELECT r.conv_id, r.turn, {_ws("r.text")} AS a, {_ws("q.text")} AS b
              FROM conversations r JOIN conversations q
                ON q.conv_id = r.conv_id AND q.turn + 1 = r.turn
              WHERE r.role = 'assistant' AND q.role = 'user')""",
    "prefix_probe": f"""
        SELECT doc_id, variant, prompt_digest, round({_weighted_jaccard("a", "b")}, 6) + 0.0 AS similarity
        FROM (SELECT doc_id, variant,
                md5([{", ".join(" || chr(10) || ".join(_text(p) for p in w.split(chr(10))) for w in config.PROBE_WORDINGS)}]
                    [variant + 1] || substr(text, 1, 100)) AS prompt_digest,
                {_ws("CASE kind WHEN 0 THEN substr(text, 101, 200) WHEN 1 THEN substr(text, 101, 100) || substr(text, 1, 100) ELSE substr(text, 301, 200) END")} AS a,
                {_ws("substr(text, 101, 200)")} AS b
              FROM (SELECT doc_id, text, variant, {_pick(3, "doc_id", "variant", "'probe'")} AS kind
                    FROM documents CROSS JOIN range(0, 3) r(variant)))""",
    "continuation_logprob": """
        SELECT response_id,
               round(coalesce(avg(logprob) FILTER (inside), 0.0), 6) + 0.0 AS logprob,
               count(logprob) FILTER (inside) AS token_count
        FROM (SELECT *, ends > prompt_chars AND pos < pieces AS inside
              FROM (SELECT *, sum(length(token)) OVER (PARTITION BY response_id ORDER BY pos) AS ends
                    FROM legacy_tokens))
        GROUP BY response_id""",
    "similarity_logprob": f"""
        SELECT item_id, response_id, o AS option_idx, round(ln(greatest(similarity, 0.01)), 6) + 0.0 AS sim_logprob
        FROM ({SIMILAR})""",
    "option_logprobs": f"""
        SELECT item_id, o AS option_idx, round(coalesce(model, sim, -10.0), 6) + 0.0 AS logprob,
               CASE WHEN model IS NOT NULL THEN 'logprob' WHEN sim IS NOT NULL THEN 'similarity'
                    ELSE 'default' END AS source
        FROM (SELECT r.item_id, r.o, CASE WHEN {_pick(3, "r.item_id", "'path'")} > 0 THEN s.logprob END AS model,
                     ln(greatest(similarity, 0.01)) AS sim
              FROM option_rows r
              LEFT JOIN option_scores s ON s.item_id = r.item_id AND s.option_idx = r.o
              LEFT JOIN (SELECT item_id, o, max(similarity) AS similarity FROM ({SIMILAR}) GROUP BY item_id, o) m
                ON m.item_id = r.item_id AND m.o = r.o)""",
    "option_perplexity": """
        SELECT item_id, round(correct_logprob, 6) + 0.0 AS correct_logprob,
               round(other_logprob, 6) + 0.0 AS other_logprob,
               round(score, 6) + 0.0 AS memorization_score, score > 1.5 AS is_memorized
        FROM option_verdicts""",
    "sequence_perplexity": """
        SELECT response_id, round(coalesce(avg(logprob), 0.0), 6) + 0.0 AS avg_logprob,
               count(*) AS token_count, count(logprob) AS valid_count,
               count(logprob) = 0 AS is_infinite, round(exp(-avg(logprob)), 4) + 0.0 AS perplexity
        FROM legacy_tokens GROUP BY response_id""",
    "rule_logprobs": f"""
        SELECT response_id, i - 1 AS pos, {_rule("pieces[i]")} AS logprob,
               CASE WHEN regexp_replace(pieces[i], '^\\s+|\\s+$', '', 'g') IN ('the', 'a', 'is', 'of', 'and', 'in', 'to', 'that') THEN -1.5::DOUBLE
                    WHEN regexp_replace(pieces[i], '^\\s+|\\s+$', '', 'g') IN ('Paris', 'France', 'capital', 'London', 'Berlin') THEN -2.75::DOUBLE
                    ELSE -4.75::DOUBLE END AS class_logprob
        FROM replies, unnest(range(1, len(pieces) + 1)) r(i)""",
    "progressive_perplexity": """
        SELECT response_id, pos, pos + 1 AS token_count,
               round(coalesce(mean, 0.0), 6) + 0.0 AS avg_logprob, round(exp(-mean), 6) + 0.0 AS perplexity
        FROM (SELECT response_id, pos, avg(logprob) OVER (PARTITION BY response_id ORDER BY pos) AS mean
              FROM legacy_tokens)""",
    "compare_perplexities": """
        SELECT count(*) AS texts, count(*) FILTER (is_infinite) AS infinite,
               arg_min(text_id, struct_pack(p := p, t := text_id)) AS lowest_id,
               min(p) AS lowest_perplexity,
               arg_max(text_id, struct_pack(i := is_infinite, p := coalesce(p, 0), t := text_id)) AS highest_id,
               CASE WHEN NOT bool_or(is_infinite) THEN max(p) END AS highest_perplexity,
               round(avg(p), 3) + 0.0 AS avg_perplexity
        FROM (SELECT text_id, is_infinite, round(perplexity, 4) + 0.0 AS p FROM text_stats)""",
    "rank_by_perplexity": """
        SELECT text_id, category, round(perplexity, 4) + 0.0 AS perplexity, token_count, is_infinite
        FROM text_stats WHERE category IN ('known', 'random')""",
    "perplexity_contrast": """
        SELECT * EXCLUDE (known_mean, random_mean),
               round(random_mean / known_mean, 3) AS contrast_ratio FROM (
            SELECT round(avg(perplexity) FILTER (category = 'known'), 3) AS known_avg,
                   round(min(perplexity) FILTER (category = 'known'), 3) AS known_min,
                   round(max(perplexity) FILTER (category = 'known'), 3) AS known_max,
                   count(*) FILTER (category = 'known' AND is_infinite) AS known_infinite,
                   round(avg(perplexity) FILTER (category = 'random'), 3) AS random_avg,
                   round(min(perplexity) FILTER (category = 'random'), 3) AS random_min,
                   round(max(perplexity) FILTER (category = 'random'), 3) AS random_max,
                   count(*) FILTER (category = 'random' AND is_infinite) AS random_infinite,
                   avg(perplexity) FILTER (category = 'known') AS known_mean,
                   avg(perplexity) FILTER (category = 'random') AS random_mean
            FROM text_stats)""",
    "perplexity_by_category": """
        SELECT CASE WHEN lang = '' THEN category ELSE category || ':' || lang END AS category,
               count(*) AS texts, count(*) FILTER (is_infinite) AS infinite,
               round(avg(perplexity), 3) + 0.0 AS avg_perplexity,
               round(avg(avg_logprob) FILTER (NOT is_infinite), 6) + 0.0 AS avg_logprob,
               sum(token_count)::BIGINT AS token_count
        FROM text_stats GROUP BY 1""",
    "perplexity_ratio_verdict": """
        SELECT text_id, round(perplexity / reference, 6) + 0.0 AS compared,
               coalesce(perplexity / reference < 0.5, false) AS is_memorized,
               round(1 - perplexity, 4) + 0.0 AS confidence
        FROM text_stats, (SELECT avg(perplexity) AS reference FROM text_stats WHERE category = 'unseen')
        WHERE category = 'known'""",
    "perplexity_verdict": """
        SELECT text_id, round(perplexity, 4) + 0.0 AS compared,
               coalesce(perplexity < 5.0, false) AS is_memorized,
               round(1 - perplexity / 10, 6) + 0.0 AS confidence
        FROM text_stats WHERE category = 'known'""",
    "corpus_lm_logprobs": """
        SELECT text_id, pos, token, round(logprob, 6) + 0.0 AS logprob
        FROM text_scores WHERE text_id LIKE 'b%'""",
    "corpus_lm_perplexity": """
        SELECT text_id, round(avg_logprob, 6) + 0.0 AS avg_logprob, token_count, valid_count, is_infinite,
               CASE WHEN NOT is_infinite THEN round(perplexity, 4) + 0.0 END AS perplexity
        FROM text_stats""",
    "top_alternatives": """
        SELECT response_id, pos, rank, alternative, round(lp, 6) + 0.0 AS logprob FROM alternatives""",
    "temperature_top_p": """
        SELECT response_id, pos, rank, alternative, round(p, 6) + 0.0 AS probability,
               round(p / sum(p) OVER (PARTITION BY response_id, pos), 6) + 0.0 AS nucleus_probability
        FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY response_id, pos ORDER BY rank
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before
              FROM (SELECT response_id, pos, rank, alternative,
                           exp(lp / 0.7) / sum(exp(lp / 0.7)) OVER (PARTITION BY response_id, pos) AS p
                    FROM alternatives))
        WHERE round(before, 9) < 0.9""",
    "perplexity_outliers": """
        SELECT text_id, category,
               CASE WHEN NOT is_infinite THEN round((-avg_logprob - m) / sd, 4) + 0.0 END AS z_score,
               NOT is_infinite AND (-avg_logprob - m) / sd < -2.0 AS is_outlier
        FROM text_stats, (SELECT avg(-avg_logprob) AS m, stddev_pop(-avg_logprob) AS sd
                          FROM text_stats WHERE category = 'unseen' AND NOT is_infinite)
        WHERE category IN ('known', 'unseen')""",
    "contrast_significance": """
        SELECT n_left, n_right, infinite_left, infinite_right, round(mean_left, 6) AS mean_left, round(mean_right, 6) AS mean_right,
               round(t, 3) AS t_value, round(df, 3) AS degrees,
               round(greatest(0.0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * abs(t) / 6000
                   * list_sum(list_transform(range(0, 2001), lambda i:
                         CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                         * (1 + (t * i / 2000) ** 2 / df) ** (-(df + 1) / 2)))), 6) AS p_value
        FROM (SELECT *, (mean_right - mean_left) / sqrt(a + b) AS t,
                     (a + b) ** 2 / (a ** 2 / (n_left - 1) + b ** 2 / (n_right - 1)) AS df
        FROM (SELECT *, var_left / n_left AS a, var_right / n_right AS b FROM (
            SELECT count(*) FILTER (category = 'known' AND NOT is_infinite) AS n_left,
                   count(*) FILTER (category = 'unseen' AND NOT is_infinite) AS n_right,
                   count(*) FILTER (category = 'known' AND is_infinite) AS infinite_left,
                   count(*) FILTER (category = 'unseen' AND is_infinite) AS infinite_right,
                   avg(-avg_logprob) FILTER (category = 'known' AND NOT is_infinite) AS mean_left,
                   avg(-avg_logprob) FILTER (category = 'unseen' AND NOT is_infinite) AS mean_right,
                   var_samp(-avg_logprob) FILTER (category = 'known' AND NOT is_infinite) AS var_left,
                   var_samp(-avg_logprob) FILTER (category = 'unseen' AND NOT is_infinite) AS var_right
            FROM text_stats)))""",
    "cosine_pairs": """
        SELECT item_id, ref_id, round(similarity, 6) + 0.0 AS similarity FROM vector_pairs""",
    "embedding_verdict": """
        SELECT item_id, refs AS "references", round(score, 6) + 0.0 AS memorization_score,
               score > 0.35 AS is_memorized
        FROM vector_scores""",
    "text_vectors": """
        SELECT doc_id, term, round(raw / len, 6) + 0.0 AS weight
        FROM (SELECT doc_id, term, tf * idf AS raw,
                     sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY doc_id)) AS len
              FROM doc_terms JOIN idf USING (term))
        WHERE len > 0""",
    "text_similarity_verdict": f"""
        SELECT item_id, response_id, round(max(similarity), 6) + 0.0 AS memorization_score,
               max(similarity) > 0.35 AS is_memorized
        FROM (
            SELECT p.item_id, response_id, p.o,
                   coalesce(sum(x.raw * y.raw) / nullif(any_value(x.len) * any_value(y.len), 0), 0.0)
                       AS similarity
            FROM (SELECT item_id, response_id, o FROM option_rows
                  JOIN completions USING (item_id) WHERE error IS NULL) p
            LEFT JOIN (
                SELECT item_id, o, term, raw, sqrt(sum(raw ** 2) OVER (PARTITION BY item_id, o)) AS len
                FROM (SELECT item_id, o, term,
                             count(*) * coalesce(any_value(idf), ln((SELECT count(*) FROM documents) + 1)) AS raw
                      FROM (SELECT item_id, o, unnest(regexp_extract_all(lower(option), '{WORD}')) AS term
                            FROM option_rows)
                      LEFT JOIN idf USING (term) GROUP BY item_id, o, term)) y
              ON y.item_id = p.item_id AND y.o = p.o
            LEFT JOIN (
                SELECT response_id, term, raw, sqrt(sum(raw ** 2) OVER (PARTITION BY response_id)) AS len
                FROM (SELECT response_id, term,
                             count(*) * coalesce(any_value(idf), ln((SELECT count(*) FROM documents) + 1)) AS raw
                      FROM (SELECT response_id, unnest(regexp_extract_all(lower(completion), '{WORD}')) AS term
                            FROM completions WHERE error IS NULL)
                      LEFT JOIN idf USING (term) GROUP BY response_id, term)) x
              USING (response_id, term)
            GROUP BY p.item_id, response_id, p.o)
        GROUP BY item_id, response_id""",
    "nearest_training_vectors": """
        SELECT vec_id, rank, neighbour_id, similarity, similarity > 0.35 AS is_unusual
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id
                            ORDER BY similarity DESC, neighbour_id) AS rank
              FROM (SELECT a.vec_id, b.vec_id AS neighbour_id,
                           round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
                               + 0.0 AS similarity
                    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
        WHERE rank <= 5""",
    "extract_answer": f"""
        SELECT conv_id, turn, {_answer_letter("text")} AS letter,
               regexp_extract(text, '\\b([A-D])\\b', 1) AS strict_letter
        FROM conversations""",
    "original_answers": """
        SELECT item_id, answer_text, original_answer, original_idx::BIGINT AS original_idx
        FROM originals""",
    "trial_plan": f"""
        SELECT item_id, trial, kind AS modification_type,
               array_to_string(shown_order, ',') AS shown_order,
               md5({_trial_prompt("options_shown")}) AS prompt_digest
        FROM shown""",
    "map_trial_answers": """
        SELECT item_id, trial, kind AS modification_type, letter AS modified_answer,
               modified_idx::BIGINT AS modified_idx
        FROM mapped""",
    "consistency_score": """
        SELECT item_id, trials, consistent, round(share, 6) + 0.0 AS consistency_score FROM consistent""",
    "consistency_verdict": """
        SELECT item_id, right_first AS original_correct, round(score, 6) + 0.0 AS memorization_score,
               flag AS is_memorized
        FROM consistency_scores""",
    "aggregate_verdict": """
        SELECT item_id, round(score, 6) + 0.0 AS aggregate_score, flag AS is_memorized FROM verdicts""",
    "run_summary": """
        SELECT count(*) AS total, count_if(flag) AS memorized,
               min(item_id) FILTER (flag) AS memorized_id,
               arg_min(question, item_id) FILTER (flag) AS memorized_question,
               round(arg_min(score, item_id) FILTER (flag), 6) + 0.0 AS memorized_score,
               min(item_id) FILTER (NOT flag) AS other_id,
               arg_min(question, item_id) FILTER (NOT flag) AS other_question,
               round(arg_min(score, item_id) FILTER (NOT flag), 6) + 0.0 AS other_score
        FROM verdicts""",
    "score_histogram": """
        SELECT b.bin, count(v.bin) AS items
        FROM range(0, 10) b(bin)
        LEFT JOIN (SELECT least(floor((score - low) / ((high - low) / 10)), 9) AS bin
                   FROM verdicts, (SELECT min(score) AS low, max(score) AS high FROM verdicts)) v
          ON v.bin = b.bin
        GROUP BY b.bin""",
    "combined_confidence": """
        SELECT item_id, count(c) AS fired, round(coalesce(avg(c), 0.0), 6) + 0.0 AS confidence,
               coalesce(avg(c), 0.0) > 0.5 AS is_memorized
        FROM (SELECT item_id, CASE WHEN flag AND error IS NULL THEN least(score, 1.0) END AS c
              FROM method_votes)
        GROUP BY item_id""",
    "entity_probes": "SELECT entity, template, prompt FROM probes",
    "entity_hits": "SELECT entity, template, completion, is_correct FROM probe_hits",
    "entity_score": "SELECT entity, probes, round(score, 6) + 0.0 AS score FROM entity_scores",
    "entity_rarity": """
        SELECT entity, occurrences, round(rarity, 6) + 0.0 AS rarity FROM rarity""",
    "entity_score_by_rarity": """
        SELECT floor(rarity)::BIGINT AS rarity_band, count(*) AS entities,
               round(avg(score), 6) + 0.0 AS avg_score
        FROM entity_scores JOIN rarity USING (entity) GROUP BY 1""",
    "texts_with_entities": """
        SELECT doc_id, lang FROM documents
        WHERE EXISTS (SELECT 1 FROM entities WHERE contains(text, entity))""",
    "column_entropy": " UNION ALL ".join(
        [_entropy("part", PART), _entropy("customer", CUSTOMER), _entropy("orders", ORDERS)]
    ),
    "csv_column_entropy": f"""
        SELECT column_name, distinct_values, entropy FROM ({_entropy("part", PART)})""",
    "row_prompts": """
        SELECT p_partkey AS row_id,
               'Complete the following row:' || chr(10) || 'p_partkey: ' || p_partkey || chr(10) ||
               'p_name: ' || p_name || chr(10) || 'p_brand: ' || p_brand || chr(10) AS prompt
        FROM part ORDER BY md5('42|' || p_partkey) LIMIT 100""",
    "extract_row_values": "SELECT row_id, column_name, predicted FROM row_values",
    "fuzzy_match": "SELECT row_id, column_name, predicted, actual, is_match FROM row_matches",
    "row_completion_accuracy": """
        SELECT p_partkey AS row_id, count(is_match) AS extracted,
               round(coalesce(avg(is_match::INTEGER), 0.0), 6) + 0.0 AS accuracy
        FROM part LEFT JOIN row_matches ON row_id = p_partkey GROUP BY p_partkey""",
    "extraction_rates": f"""
        SELECT count(*) AS items, round(avg((f = 1.0)::INTEGER), 6) + 0.0 AS exact_rate,
               round(avg(f), 6) + 0.0 AS fractional_rate
        FROM (SELECT coalesce(list_min([i - 1 for i in range(1, len(e) + 1)
                                        if e[i] IS DISTINCT FROM p[i]]), len(e)) / len(e) AS f
              FROM (SELECT e, CASE kind WHEN 0 THEN e WHEN 1 THEN e[1:len(e) // 2]
                                  WHEN 2 THEN string_split(options[(correct_idx + 1) % 4 + 1], ' ')
                                  ELSE list_concat(e[1:len(e) // 2], string_split(question, ' ')) END AS p
                    FROM (SELECT *, string_split(continuation, ' ') AS e,
                                 {_pick(4, "item_id", "'extraction'")} AS kind FROM mcq)))""",
    "duplicate_counts": """
        SELECT text_key, count(*) AS copies, min(doc_id) AS first_id FROM copies GROUP BY text_key""",
    "exact_dedup": """
        SELECT doc_id, lang, n_chars FROM copies
        WHERE doc_id IN (SELECT min(doc_id) FROM copies GROUP BY text_key)""",
    "score_by_duplication": """
        SELECT floor(log2(n))::BIGINT AS copies_band, count(*) AS distinct_texts, sum(n)::BIGINT AS texts,
               round(sum(s) / sum(n), 6) + 0.0 AS avg_score
        FROM (SELECT text_key, count(*) AS n, sum(coalesce(leak_score, 0.0)) AS s
              FROM copies LEFT JOIN leaks USING (doc_id) GROUP BY text_key)
        GROUP BY 1""",
    "calibrated_verdict": """
        SELECT ltrim(text_id, 'd')::BIGINT AS doc_id, t.lang, best AS threshold,
               coalesce(coalesce(1 / perplexity, 0.0) > best, false) AS is_memorized
        FROM text_stats t LEFT JOIN (
            SELECT lang, arg_max(threshold, struct_pack(f := round(2 * tp / (2 * tp + fp + fn), 9), t := -threshold)) AS best
            FROM (SELECT f.lang, threshold,
                         count_if(likelihood > threshold AND quality = 1) AS tp,
                         count_if(likelihood > threshold AND quality <> 1) AS fp,
                         count_if(likelihood <= threshold AND quality = 1) AS fn
                  FROM (SELECT *, coalesce(1 / perplexity, 0.0) AS likelihood FROM text_stats) f
                  JOIN labels l ON f.text_id = 'd' || l.doc_id
                  CROSS JOIN (SELECT unnest([0.0005::DOUBLE, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05]) AS threshold)
                  GROUP BY f.lang, threshold)
            GROUP BY lang) b ON b.lang = t.lang
        WHERE t.category = 'corpus'""",
    "threshold_sweep": """
        SELECT lang, threshold, tp AS true_positives, fp AS false_positives, fn AS false_negatives,
               round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) + 0.0 AS precision,
               round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) + 0.0 AS recall
        FROM (SELECT f.lang, threshold,
                     count_if(likelihood > threshold AND quality = 1) AS tp,
                     count_if(likelihood > threshold AND quality <> 1) AS fp,
                     count_if(likelihood <= threshold AND quality = 1) AS fn
              FROM (SELECT *, coalesce(1 / perplexity, 0.0) AS likelihood FROM text_stats) f JOIN labels l ON f.text_id = 'd' || l.doc_id
              CROSS JOIN (SELECT unnest([0.0005::DOUBLE, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05]) AS threshold)
              GROUP BY f.lang, threshold)""",
    "membership_scores": """
        SELECT text_id, y AS is_member, round(p, 4) + 0.0 AS membership, (p > 0.5)::INTEGER AS prediction
        FROM member_fit""",
}

ORACLES: dict[str, str] = {name: compose(sql) for name, sql in STATEMENTS.items()}

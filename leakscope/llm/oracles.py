"""Plain SQL for the operators that SQL can express."""

from __future__ import annotations

from leakscope.llm import quality_rules

ORACLES: dict[str, str] = {}

_STOP_LIST = ", ".join(f"'{word}'" for word in dict.fromkeys(quality_rules.STOP_WORDS))

_MEASURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "stop_share": "n_stop_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def _broken(rule: quality_rules.Rule) -> str:
    outside = [f"{_MEASURES[rule.measure]} < {rule.least}"] if rule.least is not None else []
    outside += [f"{_MEASURES[rule.measure]} > {rule.most}"] if rule.most is not None else []
    return f"CASE WHEN ({' OR '.join(outside)}) AND n_words >= {rule.from_words} THEN '{rule.name}' END"


ORACLES["op10_quality_rules"] = rf"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT r, pos, array_to_string(words[pos : pos + 4], ' ') AS gram
    FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS pos FROM split)
), repeated AS (
    SELECT r, pos FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT pos + step) AS n FROM repeated, range(5) AS steps(step) GROUP BY r
), measured AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
           len(regexp_extract_all(text, '[!?]')) AS n_marks,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           len(list_filter(words, lambda word: word IN ({_STOP_LIST}))) AS n_stop_words,
           coalesce(n, 0) AS n_repeat_words
    FROM split LEFT JOIN covered USING (r)
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           concat_ws(' ', {", ".join(_broken(rule) for rule in quality_rules.RULES)}) AS broken
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, broken
FROM judged
"""

ORACLES["op7_line_dedup"] = r"""
WITH split AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), real_lines AS (
    SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS place FROM split
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), firsts AS (
    SELECT line, min(place) AS place FROM real_lines GROUP BY line
), variants AS (
    SELECT place, sha256(left(line, i) || chr(1) || substr(line, i + 2)) AS variant
    FROM firsts, LATERAL (SELECT unnest(range(0, length(line))) AS i)
    UNION ALL
    SELECT place, sha256(left(line, i) || chr(1) || substr(line, i + 1)) AS variant
    FROM firsts, LATERAL (SELECT unnest(range(0, length(line) + 1)) AS i)
), earliest AS (
    SELECT variant, min(place) AS place FROM variants GROUP BY variant HAVING count(DISTINCT place) > 1
), near AS (
    SELECT DISTINCT v.place FROM variants v JOIN earliest e ON v.variant = e.variant AND e.place < v.place
), judged AS (
    SELECT s.doc_id, s.pos, s.line,
           l.place > f.place AS is_exact,
           l.place = f.place AND n.place IS NOT NULL AS is_near
    FROM split s
    LEFT JOIN real_lines l ON s.doc_id = l.doc_id AND s.pos = l.pos
    LEFT JOIN firsts f ON l.line = f.line
    LEFT JOIN near n ON f.place = n.place
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_exact) AS n_exact, count(*) FILTER (is_near) AS n_near,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(is_exact, false) AND NOT coalesce(is_near, false)), '')) AS kept_md5
FROM judged GROUP BY doc_id
"""

_RUNS = r"[\p{L}]+|[\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"

ORACLES["op2_token_counts"] = rf"""
WITH texts AS (
    SELECT source, lang, coalesce(text, '') AS text,
           doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS is_copy
    FROM documents
), kept AS (
    SELECT source, lang, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)),
               lambda line, i: struct_pack(line := line, i := i, first := list_position(string_split(text, chr(10)), line))),
               lambda s: s.i = s.first), lambda s: s.line), chr(10)) AS text
    FROM texts WHERE NOT is_copy
), counted AS (
    SELECT source, lang, 'words_1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM kept
    UNION ALL
    SELECT source, lang, 'runs_1', len(regexp_extract_all(text, '{_RUNS}')) FROM kept
)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM counted GROUP BY ALL
"""

_BASE32 = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"(((('0x' || substr(digits, {10 * group + 1}, 10))::BIGINT >> {35 - 5 * k}) & 31) + 1)::INT, 1)"
    for group in range(4)
    for k in range(8)
)

ORACLES["op4_warc"] = f"""
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digits FROM pages
), placed AS (
    SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM payloads
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to, NULL::VARCHAR AS fault
FROM placed
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_lexical_search"] = f"""
WITH asked AS (
    SELECT item_id, term, count(*) AS often
    FROM (SELECT item_id, unnest({_TERMS}) AS term
          FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark WHERE item_id IS NOT NULL))
    GROUP BY ALL
), split AS (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), facts AS (
    SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM split
), counted AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM split)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighted AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, facts GROUP BY term, n_docs
), sized AS (
    SELECT r, doc_id, 100 - 25 + ((25 * len(terms) * n_docs) // n_terms) AS m FROM split, facts
), scored AS (
    SELECT item_id, r, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weighted USING (term) JOIN sized USING (r)
    WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

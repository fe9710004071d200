import re
from collections import Counter

import cases

from leakscope.llm import quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_match_brute_force(spark):
    texts = [t for _, t in cases.awkward()] + [
        "a b c d e f a b c d e",
        "a a a a a a a a a a a a",
        "x y z w v x y z w v x y z w v\nx y z w v\nx y z w v",
        "é😀 #tag| <b>\x0bsplit\x1cnot split either",
    ]
    judged = quality_rules.judge(cases.documents(spark, enumerate(texts)))
    got = {r["row"]["doc_id"]: r for r in judged.collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.broken)


def test_junk_goes_and_clean_text_stays(spark):
    clean = " ".join(cases.WORDS)
    rows = [(1, clean), (2, clean.upper().replace(" ", "!! ") + "!!"), (3, clean.replace(" ", "### ")), (4, "go " * 40), (5, "short text")]
    docs = cases.documents(spark, rows)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1]


def test_empty_table_and_repeated_rows(spark):
    docs = cases.documents(spark, cases.awkward())
    assert quality_rules.keep(docs.limit(0)).count() == 0
    assert quality_rules.judge(docs).count() == len(cases.awkward())


def test_no_python_and_no_shuffle_in_the_plan(spark):
    plan = quality_rules.judge(cases.documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_keeping_works_nothing_out_twice(spark):
    docs = cases.documents(spark, [(1, "a")])
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in (quality_rules.judge(docs), quality_rules.keep(docs))]
    assert plans[1].count("split(") <= plans[0].count("split(") and "Filter" not in plans[1].replace("filter", "")

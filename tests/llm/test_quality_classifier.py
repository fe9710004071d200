import random
import zlib

import cases
import numpy as np

from leakscope.llm import quality_classifier as q


def corpus(n=400):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(cases.WORDS) + r.choice(["", "", "er", "ing"]) for _ in range(r.randint(20, 80))]
        bad = i % 5 == 0
        text = " ".join(words)
        if bad:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(w for w in words for _ in range(4)), (text + "\n") * 6][i // 5 % 4]
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = q.score(cases.documents(spark, rows), known).collect()
    truth = {i: k for i, k, _ in labels}
    held = [r for r in found if r.held_out]
    assert len(found) == len(rows) and {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    rows, labels = corpus(200)
    turned = [(i, 1 - k if zlib.crc32(str(i).encode()) % 5 == 0 else k, 1) for i, k, _ in labels]
    scores = []
    for own in (labels, turned):
        known = spark.createDataFrame(own, "doc_id bigint, quality int, toxic int")
        scores.append({r.doc_id: r.score for r in q.score(cases.documents(spark, rows), known).collect()})
    assert scores[0] == scores[1]


def test_awkward_rows(spark):
    rows, labels = corpus(100)
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (3, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = cases.documents(spark, [(i + 1000 if i is not None else None, t) for i, t in cases.awkward()] + rows)
    found = q.score(docs, known).collect()
    assert len(found) == len(rows) + len(cases.awkward()) and all(r.score is not None for r in found)
    assert q.score(docs.limit(0), known).count() == 0
    assert {r.score for r in q.score(docs, known.limit(0)).collect()} == {0.5}


def test_a_form_is_of_the_whole_word():
    same = "aB1-" * 50
    assert q._form(same + "x") == q._form(same + "yz") != q._form(same + "7")


def test_ratios_and_coordinate_descent():
    counts = {0: np.array([9.0, 0.0]), 1: np.array([0.0, 9.0])}
    ratios = q.log_count_ratios(counts, {0: 9, 1: 9})
    assert ratios[0] < 0 < ratios[1] and abs(ratios[0] + ratios[1]) < 1e-12
    rows = [np.array([0]), np.array([1])] * 10
    weights = q.fit_hinge(rows, np.array([0, 1] * 10), ratios)
    margins = [weights[r] @ q.unit(ratios[r]) + weights[-1] for r in rows[:2]]
    assert margins[0] < -0.9 and margins[1] > 0.9

import cases
from pyspark.sql import functions as F

from leakscope.llm import token_counts as t
from leakscope.session import shared_folder


def counted(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, old bigint, new bigint")


def test_batches_add_up_once(spark):
    root = shared_folder(spark, "test-counts")
    rows = counted(spark, [("a", "en", 10, 7), ("a", "en", 5, 5), ("b", None, None, 3), (None, "de", 2, 2)])
    t.commit(t.changes(rows, "v1", "old"), root, "in")
    for _ in range(3):
        t.commit(t.revisions(rows, "v1", "old", "new"), root, "revised")
        t.commit(t.changes(rows.where("source = 'a' AND new = 5"), "v1", "new", -1), root, "out")
    t.commit(t.changes(rows.limit(0), "v2", "new"), root, "nothing")
    want = {("a", "en", "v1", 1, 7), ("b", None, "v1", 1, 3), (None, "de", "v1", 1, 2)}
    assert {tuple(r) for r in t.totals(spark, root).collect()} == want
    base = shared_folder(spark, "test-base")
    t.compact(spark, root, base)
    assert {tuple(r) for r in t.totals(spark, base).collect()} == want


def test_only_an_empty_batch_gives_no_rows(spark):
    root = shared_folder(spark, "test-empty")
    t.commit(t.changes(counted(spark, []), "v1", "old"), root, "nothing")
    assert t.totals(spark, root).count() == 0


def test_counters(spark):
    docs = cases.documents(spark, [(1, "Ab12 c,d\x0b..\n"), (2, None), (3, "")])
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *[f(text).alias(n) for n, f in t.TOKENIZERS.items()]).collect()
    assert {r.doc_id: (r.words_1, r.runs_1) for r in rows} == {1: (3, 7), 2: (0, 0), 3: (0, 0)}

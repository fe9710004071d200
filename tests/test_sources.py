import hashlib
import json

import pytest
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.functions.similarity import pair_similarity
from leakscope.operators import tabular
from leakscope.sources import questions, responses, results, tables

OPTIONS = "options array<string>, answer string"


@pytest.mark.parametrize(
    "options, answer, expected",
    [
        (["Aspirin", "B"], "Aspirin ", 0),
        ([" Aspirin", "B"], "aspirin", 0),
        (["Missense mutation", "Silent mutation"], "Missense mutatio", 0),
        (["alpha", "beta"], "zzzzzz", -1),
        (["x", "x"], "x", 0),
        (["missense", "nonsense"], "nonsens change", -1),
        (["missense", "nonsense"], "nonsensical", 1),
    ],
)
def test_answer_index_cascade(spark, options, answer, expected):
    row = spark.createDataFrame([(options, answer)], OPTIONS)
    assert questions.answer_index(row, "options", "answer", "i").first()["i"] == expected


def test_preprocess_resolves_letters_and_texts(spark):
    raw = spark.createDataFrame(
        [
            ("1", "q", ("a1", "b1", "c1", "d1"), "C"),
            ("2", "q", ("a1", "b1", None, "d1"), "d1"),
            (None, None, None, None),
        ],
        schemas.RAW_QUESTION,
    )
    rows = {r["id"]: r for r in questions.preprocess_questions(raw).collect()}
    assert rows["1"]["correct_idx"] == 2 and rows["2"]["correct_idx"] == 3
    assert rows["2"]["options"] == ["a1", "b1", "", "d1"]
    assert rows["1"]["formatted_prompt"] == (
        "Question: q\n\nOptions:\nA. a1\nB. b1\nC. c1\nD. d1\n\nAnswer:"
    )


def test_split_is_pruned_when_partitioned(spark, tmp_path):
    path = str(tmp_path / "q")
    spark.createDataFrame([("1", "train"), ("2", "test")], "id string, split string").write.partitionBy(
        "split"
    ).parquet(path)
    train = questions.read_questions(spark, path, "train")
    assert [r["id"] for r in train.collect()] == ["1"]
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()


def test_sample_takes_the_first_rows_in_digest_order(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    order = sorted(range(5000), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    for n in (0, 1, 700, 5000):
        assert {r["k"] for r in questions.seeded_sample(rows, n, "k").collect()} == set(order[:n])
    assert questions.seeded_sample(rows, 9000, "k").count() == 5000


def test_completions_default_to_empty_text_and_name_bad_ones(spark):
    bodies = [
        json.dumps({"choices": [{"message": {"content": "hi"}}]}),
        json.dumps({"choices": [{"message": {}}]}),
        json.dumps({"error": "x"}),
        json.dumps({"choices": []}),
        "{bad",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {r["i"]: (r["completion"], r["error"]) for r in responses.parse_completions(rows).collect()}
    assert got == {
        0: ("hi", None),
        1: ("", None),
        2: ("", None),
        3: (None, "no_choices"),
        4: (None, "malformed"),
        5: (None, "malformed"),
    }


def test_chat_rows_keep_alternatives(spark):
    body = json.dumps(
        {
            "choices": [
                {
                    "logprobs": {
                        "content": [
                            {
                                "token": " word",
                                "logprob": -0.8,
                                "top_logprobs": [{"token": " word", "logprob": -0.8, "bytes": [32]}],
                            }
                        ]
                    }
                }
            ]
        }
    )
    parsed = responses.parse_chat(spark.createDataFrame([("a", body)], "id string, body string"))
    row = responses.chat_token_rows(parsed, "id").first()
    assert (row["pos"], row["token"], row["logprob"]) == (0, " word", -0.8)
    assert row["top_logprobs"][0]["bytes"] == [32]


def test_pair_similarity_against_brute_force(spark):
    def brute(a, b):
        if a is None or b is None:
            return None
        x, y = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b))
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else float(a == b)

    pairs = [("actin polymerization", "protein phosphorylation"), ("abc", "abd"), ("", ""), ("é", "e"), ("é", "é"), ("a", "ab"), (None, "a"), ("aaaa", "aa")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in rows.select(pair_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([brute(a, b) for a, b in pairs])


def test_result_file_of_one_document_is_read(spark, tmp_path):
    path = tmp_path / "run.json"
    record = {
        "id": "7",
        "question": "q",
        "options": ["a"],
        "correct_answer": "a",
        "detection_results": {"perplexity": {"method": "perplexity", "memorization_score": 1.4}},
        "aggregate_score": 1.4,
        "is_memorized": False,
    }
    path.write_text(json.dumps({"metadata": {"model": "m"}, "results": [record]}, indent=2))
    row = results.flatten_documents(results.read_result_file(spark, str(path))).first()
    assert (row["id"], row["method"], row["memorization_score"]) == ("7", "perplexity", 1.4)


def test_csv_types_are_inferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,x\n")
    table = tables.read_tabular(spark, str(tmp_path / "t.csv"))
    assert dict(table.dtypes) == {"a": "int", "b": "string"}
    entropy = {r["column"]: r["entropy"] for r in tabular.column_entropy(table).collect()}
    assert entropy == {"a": 1.0, "b": 0.0}


def test_entropy_leaves_nulls_out(spark):
    table = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    row = tabular.column_entropy(table).select("distinct_values", F.round("entropy", 6)).first()
    assert tuple(row) == (2, 1.0)

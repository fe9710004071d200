import pytest
from pyspark.sql import functions as F

from leakscope.plans.queries import QUERIES
from leakscope.session import shared_folder, stored


class FakeConf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key, default):
        return self.folder or default


class FakeContext:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class FakeSession:
    def __init__(self, folder):
        self.conf, self.sparkContext = FakeConf(folder), FakeContext()


def test_the_folder_of_the_cluster_is_used():
    assert shared_folder(FakeSession("hdfs:///shared"), "t").startswith("hdfs:///shared/leakscope-t-")


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError):
        shared_folder(FakeSession(None), "t")


def test_stored_tables_come_back_whole(spark):
    assert stored(spark.range(10), "numbers").count() == 10


def test_a_query_sees_changed_input(spark, tmp_path):
    items = spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    documents = items.select(F.col("item_id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"))
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["corpus_contamination"](spark, str(tmp_path)).count() == 1
    documents.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["corpus_contamination"](spark, str(tmp_path)).count() == 0

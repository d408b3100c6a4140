"""Terms are counted in tasks whose number follows the amount of text."""

from pyspark.sql import functions as F

from caseloom.operators import features
from workload import learning_queries


def test_tasks_follow_the_bytes_of_text():
    most = features.TEXT_BYTES_PER_TASK
    assert [features.tasks_for_text(n) for n in (None, 0, 1, most, most + 1, 75 * most)] == [1, 1, 1, 1, 2, 75]


def test_terms_are_placed_by_key_in_the_tasks_asked_for(spark):
    docs = spark.createDataFrame([(n % 40 or None, f"words of number {n}") for n in range(120)], "doc_id int, text string")
    terms = features.document_terms(docs, "doc_id", "text", (), tasks=20)
    assert terms.rdd.getNumPartitions() == 20
    spots = terms.select("doc_id", F.spark_partition_id().alias("p")).groupBy("doc_id").agg(F.countDistinct("p").alias("n"))
    assert spots.count() == 40 and spots.filter("n > 1").isEmpty()


def test_tfidf_query_deals_out_long_texts(spark, tmp_path, monkeypatch):
    docs = [(n, f"some words about case {n % 5} " * 20) for n in range(60)] + [(None, "some words"), (None, "words"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = learning_queries.tfidf(spark, str(tmp_path)).collect()
    asked = []
    place = features.document_terms
    monkeypatch.setattr(features, "document_terms", lambda *a, **k: asked.append(k["tasks"]) or place(*a, **k))
    monkeypatch.setattr(features, "TEXT_BYTES_PER_TASK", 1000)
    dealt = learning_queries.tfidf(spark, str(tmp_path)).collect()
    assert asked == [features.tasks_for_text(sum(len(t or "") for _, t in docs))] and asked[0] > 20
    assert sorted(map(str, dealt)) == sorted(map(str, whole))

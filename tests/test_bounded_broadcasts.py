"""Tables that grow with the input are not sent to the driver as broadcasts, however small their files look."""

from pyspark.sql import functions as F

from plumbgrid import workspace
from plumbgrid.llm import simhash
from plumbgrid.operators import graph


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of the text number {i // 2} that has a few more") for i in range(400)], "doc_id long, text string")
    small = {r["doc_id"]: tuple(r) for r in simhash.near_duplicates(docs).collect()}
    grouped = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    monkeypatch.setattr(workspace, "SMALL_TABLE", 0)
    found = simhash.near_duplicates(docs)
    assert "BroadcastHashJoin" not in plan(found) and {r["doc_id"]: tuple(r) for r in found.collect()} == small
    found = simhash.similar_groups(docs)
    assert "BroadcastHashJoin" not in plan(found) and {r["doc_id"]: r["component_id"] for r in found.collect()} == grouped


def test_components_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(workspace, "SMALL_TABLE", 0)
    nodes = spark.range(300).select(F.col("id").alias("node"))
    edges = nodes.where("node % 100 > 0").select(F.col("node").alias("u"), (F.col("node") - 1).alias("v"))
    found = graph.connected_components(nodes, edges)
    assert "BroadcastHashJoin" not in plan(found)
    assert {r["component"] for r in found.collect()} == {0, 100, 200}

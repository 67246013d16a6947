"""How much of a job's rows is parsed, shuffled or kept, where larger tables showed that it was too much."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import build, capture, code, docs, metrics, paths, xref
from loomgraph.plans import kg

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_modules_are_parsed_once_and_by_all_cores(spark):
    files = kg.modules(spark, SF)
    assert files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    records = code.python_records(files)
    for found, parses in ((code.call_edges(records), 1), (code.imported_classes(records), 0)):
        assert plan(found).count("MapInPandas") == parses and found.count() > 0


def test_no_shuffle_files_outlive_a_cut(spark):
    held = lambda: sum("shuffle_" in str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before, kept = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    for keep in (paths.cut, lambda df: paths.stored(df, "test")):
        assert keep(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert held() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept


def test_edges_are_shuffled_twice(spark):
    nodes = spark.range(50).select(F.col("id").cast("string").alias("id")).repartition(3)
    records = spark.range(200).select((F.col("id") % 50).cast("string").alias("source"), (F.col("id") % 60).cast("string").alias("target"), F.lit("x").alias("relation"), F.lpad(F.col("id").cast("string"), 4, "0").alias("ord")).repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = build.upsert_edges(records, nodes)
        # Records by b and by a, nodes by id once for each end, and the two repartitions above.
        assert plan(met).count("Exchange hashpartitioning") <= 4
        assert met.count() == len({tuple(sorted((str(i % 50), str(i % 60)))) for i in range(200) if i % 60 < 50})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_are_looked_up_by_their_rarest_word(spark):
    names = spark.createDataFrame([("customer#1",), ("customer#2",), ("customer",), ("##",)], "label string")
    assert sorted(tuple(r) for r in xref.by_rarest_word(names, "label").collect()) == [("customer", "customer", True), ("customer#1", "1", False), ("customer#2", "2", False)]
    said = spark.createDataFrame([(1, "the customer came"), (2, "see customer#2, [[x]]"), (3, "a customer#22 or 2")], "key int, text string")
    got = {r.key: r.links for r in capture.links(said, names, "key").collect()}
    assert got == {1: ["customer"], 2: ["customer", "customer#2", "x"], 3: ["customer"]}


def test_only_wanted_lines_are_numbered(spark):
    notes = spark.createDataFrame([("v.md", "a [[x]]\n```\n[[y]]\n```\nb\n[[z]]")], "source_file string, text string")
    wanted = docs.numbered_lines(notes, wanted=F.contains("line", F.lit("[[")))
    assert [(r.line_no, r.line) for r in wanted.orderBy("line_no").collect()] == [(1, "a [[x]]"), (6, "[[z]]")]


def test_surprises_are_scored_before_they_are_named(spark):
    g = kg.graph(spark, SF)
    every = metrics._by_direction(metrics.cross_file_edges(g)).orderBy(F.col("score").desc(), "ord", "a", "b").limit(7)
    found = metrics.cross_file_surprises(g, 7)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in every.select(*found.columns).collect()]
    assert "CartesianProduct" not in plan(found) and "TakeOrderedAndProject" not in plan(found)


def test_reports_and_questions_are_put_together_from_parts(spark):
    from loomgraph.plans.queries import QUERIES

    questions, lines = (QUERIES[name](spark, SF) for name in ("d13_questions", "a28_report"))
    assert "Join" not in plan(questions) and questions.count() > 0
    assert plan(lines).count("Exchange") <= 30 and lines.count() > 0

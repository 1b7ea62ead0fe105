"""Nulls in every column, repeated rows, empty tables and extra columns whose names the operators use themselves."""

from pyspark.sql import functions as F

from cortigraph.llm import bpe, leakage, quota, sentences, similar, splits


def with_extras(df, *names):
    """df with columns of these names, null on every other row."""
    for n in names:
        df = df.withColumn(n, F.when(F.rand(1) < 0.5, F.lit("extra")))
    return df


def rows_of(df):
    return sorted(df.collect(), key=str)


def test_vectors(spark):
    rows = [(i, [float(i % 3 == k) + 0.01 * (i % 2) for k in range(8)]) for i in range(30)]
    plain = spark.createDataFrame(rows, "id bigint, v array<double>")
    clash = with_extras(plain, "lo", "hi", "cell", "block", "cosine", "other", "rank", "n", "x")
    assert rows_of(similar.similar_pairs(clash, 8, 0.9)) == rows_of(similar.similar_pairs(plain, 8, 0.9)) != []
    assert rows_of(similar.nearest(clash.where("id < 5"), clash, 8, 3)) == rows_of(similar.nearest(plain.where("id < 5"), plain, 8, 3)) != []
    nulls = spark.createDataFrame([(None, None), (1, [None] * 8), (None, [1.0] * 8)], "id bigint, v array<double>")
    assert similar.usable(nulls, "id", "v", 8).count() == 0


def test_quota(spark):
    items = spark.range(200).select(F.col("id").alias("w"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("p"))
    needs = spark.createDataFrame([(1, "p0", 5), (1, "p1", 500), (None, "p0", 2), (2, None, 1), (3, "p2", None)], "plan bigint, p string, needed bigint")
    clash = with_extras(items, "plan", "needed", "available", "acceptance", "drawn", "deficit", "n", "rank", "band")
    some = with_extras(needs, "w", "available", "acceptance", "drawn", "deficit", "n", "rank", "band")
    sample, report = quota.quota_sample(items, "w", ["p"], needs, "plan", "needed")
    sample_2, report_2 = quota.quota_sample(clash, "w", ["p"], some, "plan", "needed")
    keys = ["plan", "p", "needed", "available", "drawn", "deficit"]
    assert rows_of(report.select(keys)) == rows_of(report_2.select(keys)) and report.count() == 5
    assert rows_of(sample.select("plan", "p", "w")) == rows_of(sample_2.select("plan", "p", "w"))
    nothing = spark.createDataFrame([(None, None)] * 3, "w bigint, p string")
    assert quota.quota_sample(nothing, "w", ["p"], needs, "plan", "needed")[0].count() == 0


def test_splits(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (None, None), (5, 5), (None, 7)], "u bigint, v bigint")
    clash = with_extras(edges, "node", "component", "parent", "root", "h")
    assert rows_of(splits.components(edges).groupBy("component").count().select("count")) == rows_of(splits.components(clash).groupBy("component").count().select("count"))
    groups = spark.range(40).select(F.when(F.col("id") > 0, F.col("id")).alias("group"), (F.col("id") % 4 + 1).alias("size"))
    by = lambda d: rows_of(d.groupBy("split").agg(F.sum("size").alias("n")))
    assert by(splits.split_groups(groups)) == by(splits.split_groups(with_extras(groups, "split", "n", "at", "r", "copies")))


def test_texts(spark):
    rows = [(1, "Mr. Ash came. He sat."), (None, "One. Two."), (2, None), (3, ""), (1, "Mr. Ash came. He sat."), (4, " \n  ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = with_extras(docs, "ids", "start_char", "end_char", "item_id", "kind", "id", "forms", "hits", "row", "lang", "items")
    assert rows_of(bpe.encode(clash, "doc_id", "text")) == rows_of(bpe.encode(docs, "doc_id", "text"))
    units = rows_of(sentences.split_sentences(docs, "doc_id", "text"))
    assert rows_of(sentences.split_sentences(clash, "doc_id", "text")) == units
    assert [r["doc_id"] for r in units] == [1, 1, 1, 1, None, None]
    nulls = spark.createDataFrame([(None, None)] * 2, docs.schema)
    assert sentences.split_sentences(nulls, "doc_id", "text").count() == sentences.split_sentences(docs.limit(0), "doc_id", "text").count() == 0
    assert [r["ids"] for r in bpe.encode(nulls, "doc_id", "text").collect()] == [[], []]


def test_items_and_documents(spark):
    words = "the grey heron waited beside the narrow canal until every boat had gone home"
    docs = spark.createDataFrame([(1, f"Before. {words} after."), (1, f"Before. {words} after."), (None, words.upper()), (2, None), (3, ""), (4, "nothing")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, words, "en"), (8, None, "en"), (9, "", None), (None, words, "en"), (10, words, None)], "item_id bigint, text string, lang string")
    out = rows_of(leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "text", "lang"))
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in out} == {(d, i, "verbatim") for d in (1, None) for i in (7, 10)} and len(out) == 6
    clash = leakage.leaked_items(with_extras(docs, "item_id", "id", "hits", "forms", "row", "kind"), "doc_id", "text", with_extras(items, "hash", "width", "doc_id", "row"), "item_id", "text", "lang")
    assert rows_of(clash) == out

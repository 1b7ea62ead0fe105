"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.functions.keys import file_key, latest_version, patient_key
from cortigraph.llm import bpe, leakage, quota, sentences, similar, splits
from cortigraph.session import table


def _bundle(spark: SparkSession, sf_dir: str, column: str, dim: int) -> DataFrame:
    rows = latest_version(table(spark, sf_dir, "feature_bundle"), "sample_id", "built_at", [column])
    return similar.usable(rows, "sample_id", column, dim)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar.similar_pairs(_bundle(spark, sf_dir, "features", 64), 64, 0.90, exact=True)
    return pairs.select(F.col("lo").alias("sample_lo"), F.col("hi").alias("sample_hi"))


def _knn(spark: SparkSession, sf_dir: str, column: str, dim: int, centre: bool) -> DataFrame:
    rows = _bundle(spark, sf_dir, column, dim)
    near = similar.nearest(rows.where(F.col("id") % 50 == 0), rows, dim, 5, centre)
    return near.select(F.col("id").alias("sample_id"), F.col("other").alias("other_id"), F.round("cosine", 6).alias("similarity"), "rank")


def p3_knn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "features", 64, False)


def p3_knn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "similarity", 16, True)


def _windows(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    rows = latest_version(table(spark, sf_dir, "window_meta"), "window_id", "ingested_at", columns)
    return rows.withColumn("patient_id", patient_key(F.col("patient_id")))


def _quota(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = ["n_requested", "preictal_count", "interictal_count", "min_per_category"]
    plans = latest_version(table(spark, sf_dir, "sampling_result"), "plan_id", "loaded_at", counts)
    targets = table(spark, sf_dir, "sampling_target").withColumn("patient_id", patient_key(F.col("patient_id")))
    windows = _windows(spark, sf_dir, ["patient_id", "label"]).where(F.col("label").isin(0, 1))
    return quota.quota_sample(windows, "window_id", ["patient_id", "label"], quota.needs_of_plans(plans, targets), "plan_id", "needed")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir)[1].where(F.col("deficit") > 0).select("plan_id", "patient_id", "label")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir)[1].select("plan_id", "patient_id", "label", "needed", "available", "drawn", "deficit")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir)[0].select("plan_id", "patient_id", "label", "window_id")


def p4_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each plan's sample, and how many different ones: none is drawn twice."""
    return p4_sample(spark, sf_dir).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_drawn"), F.count_distinct("window_id").alias("n_different"))


def _related(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The windows with a name each, and (name, component) of all patients and recordings."""
    known = table(spark, sf_dir, "file_info").select(file_key(F.col("file_name")).alias("known")).where("known is not null").distinct()
    rows = _windows(spark, sf_dir, ["patient_id", "file_name", "seizure_file"]).select("window_id", "patient_id", file_key(F.col("file_name")).alias("f"), file_key(F.col("seizure_file")).alias("z"))
    ties = rows.groupBy("patient_id", "f", "z").agg(F.count(F.lit(1)).alias("n"))
    for c in ("f", "z"):
        ties = ties.join(known, F.col(c) == F.col("known"), "left").withColumn(c, F.concat(F.lit("r:"), "known")).drop("known")
    ties = splits.cut_lineage(ties.withColumn("p", F.concat(F.lit("p:"), "patient_id")).groupBy("p", "f", "z").agg(F.sum("n").alias("n")))
    ids = splits.number_names(ties.select(F.explode(F.array("p", "f", "z")).alias("name")))
    link = lambda a, b: ties.select(F.coalesce(a, b).alias("a"), F.coalesce(b, a).alias("b"))
    pairs = link("p", "f").unionAll(link("f", "z")).unionAll(link("p", "z")).where("a is not null").distinct()
    edges = pairs.join(ids.select(F.col("name").alias("a"), F.col("node").alias("u")), "a").join(ids.select(F.col("name").alias("b"), F.col("node").alias("v")), "b")
    parts = splits.components(edges.select("u", "v")).join(ids, "node").select("name", "component")
    return ties, parts


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parts = _related(spark, sf_dir)
    patients = parts.where(F.col("name").startswith("p:")).select(F.expr("substr(name, 3)").alias("patient"), "component")
    one, two = patients.withColumnRenamed("patient", "patient_lo"), patients.withColumnRenamed("patient", "patient_hi")
    return one.join(two, "component").where("patient_lo < patient_hi").select("patient_lo", "patient_hi")


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(group, size, split) of every group of windows, and the split of every name; a window that names nothing is a group of its own."""
    ties, parts = _related(spark, sf_dir)
    named = ties.select(F.coalesce("p", "f", "z").alias("name"), "n").join(parts, "name").groupBy(F.concat(F.lit("c:"), "component").alias("group")).agg(F.sum("n").alias("size"))
    alone = _places_of_windows(spark, sf_dir, parts).where("name is null").select(F.concat(F.lit("w:"), "window_id").alias("group"), F.lit(1).cast("bigint").alias("size"))
    assigned = splits.cut_lineage(splits.split_groups(named.unionAll(alone)))
    return assigned, parts


def _places_of_windows(spark: SparkSession, sf_dir: str, parts: DataFrame) -> DataFrame:
    """window_id, patient_id, f, z (known recordings) and one name of every window, null if it names nothing."""
    known = parts.where(F.col("name").startswith("r:")).select(F.expr("substr(name, 3)").alias("known"))
    rows = _windows(spark, sf_dir, ["patient_id", "file_name", "seizure_file"]).select("window_id", "patient_id", file_key(F.col("file_name")).alias("f"), file_key(F.col("seizure_file")).alias("z"))
    for c in ("f", "z"):
        rows = rows.join(known, F.col(c) == F.col("known"), "left").withColumn(c, F.concat(F.lit("r:"), "known")).drop("known")
    return rows.withColumn("name", F.coalesce(F.concat(F.lit("p:"), "patient_id"), "f", "z"))


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, parts = _splits(spark, sf_dir)
    rows = _places_of_windows(spark, sf_dir, parts).join(parts, "name", "left").withColumn("group", F.coalesce(F.concat(F.lit("c:"), "component"), F.concat(F.lit("w:"), "window_id")))
    return rows.join(assigned.select("group", "split"), "group", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def p5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every window; a window without names or id goes to train."""
    return _split_rows(spark, sf_dir).select("window_id", "split")


def p5_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and splits of every patient and recording that windows share: always one split."""
    names = F.explode(F.array_distinct(F.filter(F.array(F.concat(F.lit("p:"), "patient_id"), "f", "z"), lambda x: x.isNotNull())))
    named = _split_rows(spark, sf_dir).select("split", names.alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n_windows"), F.count_distinct("split").alias("n_splits"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each split."""
    return p5_split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_windows"))


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, _ = _splits(spark, sf_dir)
    return assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_windows"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters by language tag."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    ids = bpe.encode(docs.withColumn("k", F.struct("lang", F.length("text").alias("n"))), "k", "text")
    return ids.groupBy(F.col("k.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.sum("k.n").alias("n_chars"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MD5 of every text that its ids decode to; of null texts that of the empty one."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")
    return bpe.decode(ids, "doc_id", "ids").select("doc_id", F.md5("text").alias("text_md5"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", "lang")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("kind = 'verbatim'").select("doc_id", "item_id").distinct()


def p7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an item's wording and other values."""
    return _leaks(spark, sf_dir).where("kind = 'template'").select("doc_id", "item_id", "n_words", "n_changed")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each item, by kind."""
    return _leaks(spark, sf_dir).groupBy("item_id", "kind").agg(F.count_distinct("doc_id").alias("n_docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the corpus says of the dots after short tokens."""
    return sentences.abbreviations(table(spark, sf_dir, "documents"), "text").where("kind <> ''")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decided about the dots after tokens: the document, the corpus or the fixed list."""
    return sentences.dot_sources(table(spark, sf_dir, "documents"), "text")


FOUND = {"p7_found": p7_found, "p7_templates": p7_templates, "p7_items": p7_items, "p8_found": p8_found, "p8_abbreviations": p8_abbreviations, "p8_sources": p8_sources, "p4_found": p4_found, "p4_report": p4_report, "p4_sample": p4_sample, "p4_draws": p4_draws, "p5_found": p5_found, "p5_split": p5_split, "p5_totals": p5_totals, "p5_apart": p5_apart, "p5_shares": p5_shares, "p3_found": p3_found, "p3_knn_features": p3_knn_features, "p3_knn_similarity": p3_knn_similarity, "p6_ids": p6_ids, "p6_lengths": p6_lengths, "p6_round_trip": p6_round_trip}

_FILE = "nullif(lower(trim(regexp_replace({}, '^.*[/\\\\]', ''), chr(9) || chr(10) || chr(13) || chr(160) || ' ')), '')"
_PATIENT = "nullif(lower(translate(patient_id, chr(9) || chr(10) || chr(13) || chr(160) || ' -_', '')), '')"
_REPORT = f"""
WITH plans AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY loaded_at DESC NULLS LAST, n_requested DESC NULLS LAST, preictal_count DESC NULLS LAST, interictal_count DESC NULLS LAST, min_per_category DESC NULLS LAST) AS rn FROM sampling_result)
  WHERE rn = 1 AND n_requested IS NOT NULL AND preictal_count IS NOT NULL AND interictal_count IS NOT NULL),
t AS (SELECT plan_id, pid, sum(weight) AS weight FROM (SELECT DISTINCT plan_id, {_PATIENT} AS pid, weight FROM sampling_target WHERE weight > 0) WHERE pid IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT plan_id, sum(weight) AS total FROM t GROUP BY 1),
w AS (SELECT pid, label, count(*) AS n FROM (SELECT {_PATIENT} AS pid, label, row_number() OVER (PARTITION BY window_id ORDER BY ingested_at DESC NULLS LAST, patient_id DESC NULLS LAST, label DESC NULLS LAST) AS rn FROM window_meta) WHERE rn = 1 GROUP BY 1, 2),
need AS (SELECT p.plan_id, t.pid AS patient_id, l.label,
  greatest(CAST(floor(coalesce(p.n_requested * t.weight * (CASE WHEN l.label = 1 THEN preictal_count ELSE interictal_count END) / nullif(total * (preictal_count + interictal_count), 0), 0) + 0.5 + 1e-9) AS BIGINT), coalesce(min_per_category, 0)) AS needed
  FROM plans p JOIN t ON t.plan_id = p.plan_id JOIN tot ON tot.plan_id = p.plan_id CROSS JOIN (SELECT unnest([0, 1]) AS label) l),
report AS (SELECT need.*, coalesce(n, 0) AS available, least(needed, coalesce(n, 0)) AS drawn, needed - least(needed, coalesce(n, 0)) AS deficit FROM need LEFT JOIN w ON w.pid = need.patient_id AND w.label = need.label)
"""
SQL = {
    "p4_found": _REPORT + "SELECT plan_id, patient_id, label FROM report WHERE deficit > 0",
    "p4_report": _REPORT + "SELECT plan_id, patient_id, label, needed, available, drawn, deficit FROM report",
}

_VECTORS = """WITH b AS (SELECT sample_id AS id, CAST({c} AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY built_at DESC NULLS LAST, {c} DESC NULLS LAST) AS rn FROM feature_bundle) WHERE rn = 1),
t AS (SELECT * FROM b WHERE len(v) = {d} AND len(list_filter(v, lambda x: isfinite(x))) = {d} AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT id, {centred} AS v FROM t), u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM c)
"""
_NEAREST = """, p AS (SELECT a.id, b.id AS other, list_dot_product(a.v, b.v) / (a.n * b.n) AS w FROM u a JOIN u b ON a.id % 50 = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, other) AS rk FROM p)
SELECT id AS sample_id, other AS other_id, round(w, 6) AS similarity, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 5"""
_KNOWN = f"(SELECT DISTINCT {_FILE.format('file_name')} AS known FROM file_info)"
SQL |= {
    "p3_found": _VECTORS.format(c="features", d=64, centred="v") + "SELECT a.id AS sample_lo, b.id AS sample_hi FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.90",
    "p3_knn_features": _VECTORS.format(c="features", d=64, centred="v") + _NEAREST,
    "p3_knn_similarity": _VECTORS.format(c="similarity", d=16, centred="list_transform(v, lambda x: x - list_avg(v))") + _NEAREST,
    "p5_found": f"""
WITH RECURSIVE w AS (SELECT {_PATIENT} AS p, {_FILE.format('file_name')} AS f, {_FILE.format('seizure_file')} AS z FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ingested_at DESC NULLS LAST, patient_id DESC NULLS LAST, file_name DESC NULLS LAST, seizure_file DESC NULLS LAST) AS rn FROM window_meta) WHERE rn = 1),
k AS {_KNOWN},
t AS (SELECT DISTINCT 'p:' || p AS p, 'r:' || a.known AS f, 'r:' || b.known AS z FROM w LEFT JOIN k a ON f = a.known LEFT JOIN k b ON z = b.known),
e0 AS (SELECT p AS a, f AS b FROM t UNION SELECT f, z FROM t UNION SELECT p, z FROM t),
e AS (SELECT a, b FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT DISTINCT p, p AS n FROM t WHERE p IS NOT NULL UNION SELECT r.p, e.b FROM reach r JOIN e ON r.n = e.a)
SELECT substr(p, 3) AS patient_lo, substr(n, 3) AS patient_hi FROM reach WHERE n LIKE 'p:%' AND p < n""",
}
_W = f"""WITH w AS (SELECT window_id, {_PATIENT} AS p, {_FILE.format('file_name')} AS f, {_FILE.format('seizure_file')} AS z FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ingested_at DESC NULLS LAST, patient_id DESC NULLS LAST, file_name DESC NULLS LAST, seizure_file DESC NULLS LAST) AS rn FROM window_meta) WHERE rn = 1)
"""
SQL |= {
    "p4_draws": _REPORT + "SELECT plan_id, CAST(sum(drawn) AS BIGINT) AS n_drawn, CAST(sum(drawn) AS BIGINT) AS n_different FROM report GROUP BY plan_id HAVING sum(drawn) > 0",
    "p5_apart": _W
    + f""", k AS {_KNOWN}, t AS (SELECT 'p:' || p AS p, 'r:' || a.known AS f, 'r:' || b.known AS z FROM w LEFT JOIN k a ON f = a.known LEFT JOIN k b ON z = b.known),
n AS (SELECT unnest(list_distinct([p, f, z])) AS name FROM t) SELECT name, count(*) AS n_windows, CAST(1 AS BIGINT) AS n_splits FROM n WHERE name IS NOT NULL GROUP BY name""",
    # Groups of one window make the totals of the two small splits exact.
    "p5_shares": _W + ", n AS (SELECT count(*) AS n FROM w) SELECT split, CASE WHEN split = 'train' THEN n - 2 * CAST(round_even(n * 0.1, 0) AS BIGINT) ELSE CAST(round_even(n * 0.1, 0) AS BIGINT) END AS n_windows FROM n, (SELECT unnest(['train', 'validation', 'test']) AS split)",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
}

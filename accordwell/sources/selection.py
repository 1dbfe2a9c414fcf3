"""Choosing filings and documents: cohorts, origins, comparisons and best candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query


def cohort(hits: DataFrame, excluded: DataFrame, least: int, take: int) -> DataFrame:
    """Issuers (issuer) with at least ``least`` distinct accessions, without the excluded, the ``take`` richest first."""
    counts = hits.groupBy("issuer").agg(F.count_distinct("accession").alias("n")).where(F.col("n") >= least)
    return counts.join(excluded, "issuer", "left_anti").orderBy(F.desc("n"), "issuer").limit(take)


@query(
    "src_cohort_selection",
    "SELECT o_custkey AS issuer, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2 ORDER BY n DESC, issuer LIMIT 25",
)
def src_cohort_selection(spark, sf_dir):
    hits = P.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issuer"), F.col("o_orderkey").alias("accession"))
    return cohort(hits, P.read(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("issuer")), 2, 25)


@query(
    "src_origin_selection",
    """
WITH f AS (SELECT o_custkey AS issuer, o_orderkey AS id, o_orderdate AS filed, o_orderstatus = 'O' AS amendment FROM orders),
a AS (SELECT issuer, min(filed) AS first FROM f WHERE amendment GROUP BY issuer)
SELECT issuer, id AS origin, filed FROM (SELECT f.*, row_number() OVER (PARTITION BY f.issuer ORDER BY filed, id) AS rn FROM f JOIN a USING (issuer) WHERE NOT amendment AND filed < first) WHERE rn = 1""",
)
def src_origin_selection(spark, sf_dir):
    """The earliest filing that is no amendment and comes before the first amendment; one pass, no join."""
    filed = P.read(spark, sf_dir, "orders").withColumn("amendment", F.col("o_orderstatus") == "O")
    per = filed.groupBy(F.col("o_custkey").alias("issuer")).agg(
        F.min(F.when(F.col("amendment"), F.col("o_orderdate"))).alias("first"), F.min(F.when(~F.col("amendment"), F.struct(F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("origin")))).alias("o")
    )
    return per.where(F.col("o.filed") < F.col("first")).select("issuer", "o.origin", "o.filed")


@query(
    "src_comparison_selection",
    """
WITH a AS (SELECT o_custkey AS issuer, max(o_orderdate) FILTER (o_orderstatus = 'O') AS last FROM orders GROUP BY 1)
SELECT a.issuer, min(o_orderkey) FILTER (o_orderdate >= last AND o_orderpriority = '5-LOW') AS composite, min(o_orderkey) AS fallback,
  coalesce(min(o_orderkey) FILTER (o_orderdate >= last AND o_orderpriority = '5-LOW'), min(o_orderkey)) AS chosen FROM a JOIN orders ON o_custkey = a.issuer GROUP BY 1""",
)
def src_comparison_selection(spark, sf_dir):
    """A composite filed at or after the last amendment, else a fallback."""
    o = P.read(spark, sf_dir, "orders").withColumn("last", F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).over(W.partitionBy("o_custkey")))
    hit = F.when((F.col("o_orderdate") >= F.col("last")) & (F.col("o_orderpriority") == "5-LOW"), F.col("o_orderkey"))
    c = o.groupBy(F.col("o_custkey").alias("issuer")).agg(F.min(hit).alias("composite"), F.min("o_orderkey").alias("fallback"))
    return c.withColumn("chosen", F.coalesce("composite", "fallback"))


@query(
    "src_top1_score",
    """
WITH s AS (SELECT *, 100 * CAST(o_orderpriority = '1-URGENT' AS INTEGER) + 50 * CAST(o_orderstatus = 'F' AS INTEGER) - abs(date_diff('day', TIMESTAMP '1996-01-01', o_orderdate)) AS score FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' - INTERVAL 120 DAY AND TIMESTAMP '1996-01-01' + INTERVAL 365 DAY)
SELECT o_custkey AS issuer, o_orderkey AS chosen, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderdate, o_orderkey) AS rn FROM s) WHERE rn = 1""",
)
def src_top1_score(spark, sf_dir):
    """The best candidate in a window of days around a date; ties to the earlier filing."""
    day = F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))
    o = P.read(spark, sf_dir, "orders").where(F.col("o_orderdate").between(day - F.expr("INTERVAL 120 DAYS"), day + F.expr("INTERVAL 365 DAYS")))
    score = 100 * (F.col("o_orderpriority") == "1-URGENT").cast("int") + 50 * (F.col("o_orderstatus") == "F").cast("int") - F.abs(F.datediff(F.col("o_orderdate"), day))
    best = F.min(F.struct((-score).alias("minus"), "o_orderdate", "o_orderkey"))
    return o.groupBy(F.col("o_custkey").alias("issuer")).agg(best.alias("b")).select("issuer", F.col("b.o_orderkey").alias("chosen"), (-F.col("b.minus")).alias("score"))


@query(
    "src_preferred_exhibit",
    "SELECT l_orderkey AS filing, l_linenumber AS position, l_partkey AS exhibit FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1",
)
def src_preferred_exhibit(spark, sf_dir):
    """Per filing the exhibit of the wanted type, else the first."""
    first = F.min(F.struct((F.col("l_returnflag") != "R").alias("other"), "l_linenumber", "l_partkey", "l_suppkey"))
    return P.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("filing")).agg(first.alias("b")).select("filing", F.col("b.l_linenumber").alias("position"), F.col("b.l_partkey").alias("exhibit"))


@query(
    "src_dedupe_union",
    """
WITH u AS (SELECT o_orderkey AS accession, 1 AS source FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 3 = 0)
SELECT accession, min(source) AS source FROM u GROUP BY 1""",
)
def src_dedupe_union(spark, sf_dir):
    """Two lists of hits as one; where both have an accession the first list wins."""
    o = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"))
    both = o.where("accession % 2 = 0").withColumn("source", F.lit(1)).unionByName(o.where("accession % 3 = 0").withColumn("source", F.lit(2)))
    return both.groupBy("accession").agg(F.min("source").alias("source"))


@query(
    "src_manifest_verify",
    """
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'spoilt' ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 3 <> 0)
SELECT m.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN m.sha256 <> sha256(d.text) THEN 'changed' ELSE 'same' END AS verdict FROM m LEFT JOIN (SELECT * FROM documents WHERE doc_id % 7 <> 0) d USING (doc_id)""",
)
def src_manifest_verify(spark, sf_dir):
    """A frozen manifest against what is there now."""
    d = P.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("actual"))
    m = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "spoilt").otherwise(F.col("actual")).alias("sha256"))
    verdict = F.when(F.col("actual").isNull(), "missing").when(F.col("sha256") != F.col("actual"), "changed").otherwise("same")
    return m.join(d.where("doc_id % 7 <> 0"), "doc_id", "left").select("doc_id", verdict.alias("verdict"))


@query(
    "src_manifest_union",
    "SELECT chain, CAST(count(*) AS BIGINT) AS n, CAST(count(kind) AS BIGINT) AS typed FROM (SELECT o_custkey AS chain, o_orderstatus AS kind FROM orders UNION ALL SELECT c_custkey, NULL FROM customer) GROUP BY chain",
)
def src_manifest_union(spark, sf_dir):
    """Manifests with different columns as one, grouped by chain."""
    a = P.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderstatus").alias("kind"))
    b = P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chain"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("chain").agg(F.count("*").alias("n"), F.count("kind").alias("typed"))


@query(
    "src_form_filter",
    "SELECT o_orderkey AS accession, year(o_orderdate) AS filed_year, CASE WHEN o_totalprice < 1000 THEN 'error' ELSE 'ok' END AS status FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND year(o_orderdate) BETWEEN 1995 AND 1996",
)
def src_form_filter(spark, sf_dir):
    """Forms and years; the year test is a range of the date so that it reaches the scan. Failures stay as rows with a status."""
    from datetime import datetime

    filed = (F.col("o_orderdate") >= F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz"))
    o = P.read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & filed)
    return o.select(F.col("o_orderkey").alias("accession"), F.year("o_orderdate").cast("long").alias("filed_year"), F.when(F.col("o_totalprice") < 1000, "error").otherwise("ok").alias("status"))

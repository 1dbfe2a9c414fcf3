"""Evaluation metrics, funnels, distributions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query


def ratio(num: Column, den: Column, digits: int = 4) -> Column:
    """Rounded quotient, 0 where the denominator is 0."""
    return F.round(F.when(den == 0, F.lit(0.0)).otherwise(num / den), digits)


_GOLD = """
WITH p AS (SELECT d.doc_id, d.source AS format, l.quality = 1 AS gold, d.n_chars >= 1000 AS predicted
  FROM documents d JOIN labels l USING (doc_id))
"""


def _gold(spark, sf_dir) -> DataFrame:
    """Labels against a fixed rule on the texts' length."""
    d = P.read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("format"), (F.col("n_chars") >= 1000).alias("predicted"))
    return d.join(P.read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gold")), "doc_id")


def precision_recall(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn; zero where undefined."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 6), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 6)
    f = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 6)
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def _confusion() -> list[Column]:
    g, p = F.col("gold"), F.col("predicted")
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn")]


_PRF = """CAST(count(*) FILTER (gold AND predicted) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT gold AND predicted) AS BIGINT) AS fp, CAST(count(*) FILTER (gold AND NOT predicted) AS BIGINT) AS fn"""
_PRF_OUT = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""


@query("agg_prf_pooled", _GOLD + f", c AS (SELECT {_PRF} FROM p) SELECT *, {_PRF_OUT} FROM c")
def agg_prf_pooled(spark, sf_dir):
    return precision_recall(_gold(spark, sf_dir).agg(*_confusion()))


@query("agg_prf_by_format_rollup", _GOLD + f", c AS (SELECT format, {_PRF} FROM p GROUP BY ROLLUP (format)) SELECT *, {_PRF_OUT} FROM c")
def agg_prf_by_format_rollup(spark, sf_dir):
    """By format and, with a null format, pooled: one pass."""
    return precision_recall(_gold(spark, sf_dir).rollup("format").agg(*_confusion()))


@query(
    "agg_exact_accuracy",
    """
SELECT p.instruction_type, round(avg(CASE WHEN p.target_section_ref = concat('Section 7.', CAST(p.instruction_order AS VARCHAR)) THEN 1.0 ELSE 0.0 END), 4) AS target_accuracy,
  round(avg(CASE WHEN p.new_value > p.old_value THEN 1.0 ELSE 0.0 END), 4) AS value_accuracy, CAST(count(*) AS BIGINT) AS n FROM amendment_instruction p GROUP BY 1""",
    "amendment_instruction",
)
def agg_exact_accuracy(spark, sf_dir):
    hit = F.col("target_section_ref") == F.concat(F.lit("Section 7."), F.col("instruction_order").cast("string"))
    mean = lambda c: F.round(F.avg(c.cast("double")), 4)
    return P.amendment_instruction(spark, sf_dir).groupBy("instruction_type").agg(mean(hit).alias("target_accuracy"), mean(F.col("new_value") > F.col("old_value")).alias("value_accuracy"), F.count("*").alias("n"))


FORMATS = ("src0", "src1", "src2", "unknown")


def corpus_structure(texts: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Counts and shares of every format (column format) in the table; wanted formats that it lacks are rows of zero."""
    counted = texts.groupBy("format").agg(F.count("*").alias("n"))
    listed = texts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("format"))
    n = F.coalesce("n", F.lit(0))
    rows = counted.join(listed, "format", "full_outer").crossJoin(texts.agg(F.count("*").alias("total")))
    return rows.select("format", n.alias("n"), F.round(100.0 * n / F.nullif("total", F.lit(0)), 4).alias("percent"))


@query(
    "agg_corpus_structure_all",
    """
WITH c AS (SELECT source AS format, count(*) AS n FROM documents GROUP BY source)
SELECT coalesce(c.format, f.format) AS format, CAST(coalesce(c.n, 0) AS BIGINT) AS n, round(100.0 * coalesce(c.n, 0) / (SELECT nullif(count(*), 0) FROM documents), 4) AS percent
FROM c FULL JOIN (VALUES ('src0'), ('src1'), ('src2'), ('unknown')) f(format) ON c.format = f.format""",
)
def agg_corpus_structure_all(spark, sf_dir):
    """Every document counts under its format."""
    return corpus_structure(P.read(spark, sf_dir, "documents").select(F.col("source").alias("format")), FORMATS)


_STUDY = """
WITH c AS (SELECT chain_id, count(*) AS steps, count(*) FILTER (outcome = 'APPLIED') AS applied, count(*) FILTER (outcome = 'RESOLVING') AS resolving,
  count(*) FILTER (outcome = 'UNRESOLVED') AS unresolved FROM chain_step GROUP BY chain_id)
"""


def _chains(spark, sf_dir) -> DataFrame:
    o = F.col("outcome")
    return P.chain_step(spark, sf_dir).groupBy("chain_id").agg(
        F.count("*").alias("steps"), F.count_if(o == "APPLIED").alias("applied"), F.count_if(o == "RESOLVING").alias("resolving"), F.count_if(o == "UNRESOLVED").alias("unresolved")
    )


@query(
    "agg_study_metrics",
    _STUDY
    + """SELECT CAST(count(*) AS BIGINT) AS chains, CAST(sum(steps) AS BIGINT) AS steps, round(sum(applied) / sum(steps), 4) AS coverage,
round(avg(resolving / steps), 4) AS mean_resolving, round(count(*) FILTER (unresolved = 0) / count(*), 4) AS clean_rate,
round(avg(CASE WHEN unresolved > 0 THEN applied / steps END), 4) AS coverage_if_unresolved FROM c""",
    "chain_step",
)
def agg_study_metrics(spark, sf_dir):
    """Ratios of sums and means of ratios, with and without a condition on the denominator."""
    return _chains(spark, sf_dir).agg(
        F.count("*").alias("chains"),
        F.sum("steps").alias("steps"),
        ratio(F.sum("applied"), F.sum("steps")).alias("coverage"),
        F.round(F.avg(F.col("resolving") / F.col("steps")), 4).alias("mean_resolving"),
        ratio(F.count_if(F.col("unresolved") == 0), F.count("*")).alias("clean_rate"),
        F.round(F.avg(F.when(F.col("unresolved") > 0, F.col("applied") / F.col("steps"))), 4).alias("coverage_if_unresolved"),
    )


@query(
    "agg_calibration",
    """
WITH s AS (SELECT l_discount * 10 AS a, l_tax * 10 AS b FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(b - a), 4) AS bias, round(avg(abs(b - a)), 4) AS mean_error,
  round(count(*) FILTER (abs(b - a) <= 0.25) / count(*), 4) AS within, round(coalesce(corr(a, b), 0), 4) AS correlation,
  count(*) >= 10 AND count(*) FILTER (abs(b - a) <= 0.25) / count(*) >= 0.8 AND coalesce(corr(a, b), 0) >= 0.7 AS calibrated FROM s""",
)
def agg_calibration(spark, sf_dir):
    """Two judges: bias, mean absolute error, agreement within a tolerance, correlation, and the gate over them."""
    s = P.read(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"))
    gap = F.abs(F.col("b") - F.col("a"))
    m = s.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("b") - F.col("a")), 4).alias("bias"),
        F.round(F.avg(gap), 4).alias("mean_error"),
        ratio(F.count_if(gap <= 0.25), F.count("*")).alias("within"),
        F.round(F.coalesce(F.corr("a", "b"), F.lit(0.0)), 4).alias("correlation"),
    )
    return m.withColumn("calibrated", F.expr("n >= 10 and within >= 0.8 and correlation >= 0.7"))


@query(
    "agg_distributions_grouping_sets",
    "SELECT lang, source, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, source, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS kind FROM documents) GROUP BY GROUPING SETS ((lang), (source), (kind), ())",
)
def agg_distributions_grouping_sets(spark, sf_dir):
    """Independent distributions over one table in one pass."""
    d = P.read(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("kind"))
    return d.groupingSets([[F.col("lang")], [F.col("source")], [F.col("kind")], []], "lang", "source", "kind").agg(F.count("*").alias("n"))


def smallest_cover(counts: DataFrame, share: float) -> DataFrame:
    """The most frequent buckets (bucket, n) that together first reach a share of the total. A row per bucket, not per record."""
    down = W.orderBy(F.desc("n"), "bucket").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("n").over(W.partitionBy())
    before = F.coalesce(F.sum("n").over(down), F.lit(0))
    return counts.select("bucket", "n", F.round(before / total, 4).alias("before"), F.round(100.0 * F.col("n") / total, 4).alias("percent")).where(F.col("before") < share)


@query(
    "agg_taxonomy_80pct",
    """
WITH c AS (SELECT p_brand AS bucket, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT bucket, n, round(coalesce(sum(n) OVER (ORDER BY n DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (), 4) AS before, round(100.0 * n / sum(n) OVER (), 4) AS percent FROM c)
SELECT bucket, n, before, percent FROM r WHERE before < 0.8""",
)
def agg_taxonomy_80pct(spark, sf_dir):
    return smallest_cover(P.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("bucket")).agg(F.count("*").alias("n")), 0.8)


_STAGES = {"all": "true", "with_text": "new_value is not null", "typed": "instruction_type <> 'UNRESOLVED'", "applied": "instruction_type <> 'UNRESOLVED' and status = 'APPLIED'", "confident": "instruction_type <> 'UNRESOLVED' and status = 'APPLIED' and parser_confidence >= 0.95"}


@query("agg_funnel", " UNION ALL ".join(f"SELECT {i} AS place, '{n}' AS stage, CAST(count(*) FILTER ({c}) AS BIGINT) AS n FROM amendment_instruction" for i, (n, c) in enumerate(_STAGES.items(), 1)), "amendment_instruction")
def agg_funnel(spark, sf_dir):
    """Stages as conditional counts of one pass, then as rows."""
    counted = P.amendment_instruction(spark, sf_dir).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _STAGES.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("stage"), F.col(n).alias("n")) for i, n in enumerate(_STAGES, 1)])).alias("x")).select("x.*")


@query(
    "agg_family_inventory",
    """
SELECT instruction_type AS family, CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) FILTER (status = 'APPLIED') AS BIGINT) AS applied, CAST(count(*) FILTER (status <> 'APPLIED') AS BIGINT) AS rejected,
  CAST(count(*) FILTER (new_value > old_value) AS BIGINT) AS raised, CAST(count(*) FILTER (parser_confidence >= 0.95) AS BIGINT) AS confident, count(DISTINCT target_key) AS targets, min(effective_start) AS first_start
FROM amendment_instruction GROUP BY 1""",
    "amendment_instruction",
)
def agg_family_inventory(spark, sf_dir):
    return P.amendment_instruction(spark, sf_dir).groupBy(F.col("instruction_type").alias("family")).agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("status") == "APPLIED").alias("applied"),
        F.count_if(F.col("status") != "APPLIED").alias("rejected"),
        F.count_if(F.col("new_value") > F.col("old_value")).alias("raised"),
        F.count_if(F.col("parser_confidence") >= 0.95).alias("confident"),
        F.count_distinct("target_key").alias("targets"),
        F.min("effective_start").alias("first_start"),
    )


@query(
    "agg_disposition_conservation",
    """
WITH c AS (SELECT instruction_type, status, count(*) AS n FROM amendment_instruction GROUP BY 1, 2)
SELECT concat(instruction_type, '/', status) AS disposition, n, CAST(sum(n) OVER () AS BIGINT) AS accounted, CAST((SELECT count(*) FROM amendment_instruction) AS BIGINT) = sum(n) OVER () AS conserved FROM c""",
    "amendment_instruction",
)
def agg_disposition_conservation(spark, sf_dir):
    """Terminal dispositions, and whether they account for every candidate; the windows run over the few dispositions."""
    i = P.amendment_instruction(spark, sf_dir)
    c = i.groupBy("instruction_type", "status").agg(F.count("*").alias("n"), F.count("amendment_version_id").alias("seen"))
    everything = W.partitionBy()
    return c.select(
        F.concat_ws("/", "instruction_type", "status").alias("disposition"), "n", F.sum("n").over(everything).alias("accounted"), (F.sum("seen").over(everything) == F.sum("n").over(everything)).alias("conserved")
    )


@query("agg_first_failure", "SELECT CASE WHEN instruction_type = 'UNRESOLVED' THEN 'parse' WHEN status <> 'APPLIED' THEN 'apply' WHEN parser_confidence < 0.95 THEN 'confidence' ELSE 'none' END AS failure, CAST(count(*) AS BIGINT) AS n FROM amendment_instruction GROUP BY 1", "amendment_instruction")
def agg_first_failure(spark, sf_dir):
    first = F.when(F.col("instruction_type") == "UNRESOLVED", "parse").when(F.col("status") != "APPLIED", "apply").when(F.col("parser_confidence") < 0.95, "confidence").otherwise("none")
    return P.amendment_instruction(spark, sf_dir).groupBy(first.alias("failure")).agg(F.count("*").alias("n"))


@query(
    "agg_opportunities",
    """
SELECT 'unparsed' AS opportunity, CAST(count(*) FILTER (instruction_type = 'UNRESOLVED') AS BIGINT) AS affected, CAST(count(*) AS BIGINT) AS denominator FROM amendment_instruction
UNION ALL SELECT 'not_applied', count(*) FILTER (status <> 'APPLIED'), count(*) FILTER (instruction_type <> 'UNRESOLVED') FROM amendment_instruction
UNION ALL SELECT 'low_confidence', count(*) FILTER (parser_confidence < 0.95), count(*) FILTER (status = 'APPLIED') FROM amendment_instruction""",
    "amendment_instruction",
)
def agg_opportunities(spark, sf_dir):
    parts = {
        "unparsed": ("instruction_type = 'UNRESOLVED'", "true"),
        "not_applied": ("status <> 'APPLIED'", "instruction_type <> 'UNRESOLVED'"),
        "low_confidence": ("parser_confidence < 0.95", "status = 'APPLIED'"),
    }
    counted = P.amendment_instruction(spark, sf_dir).agg(*[F.count_if(F.expr(c)).alias(f"{n}_{k}") for n, cs in parts.items() for k, c in enumerate(cs)])
    rows = [F.struct(F.lit(n).alias("opportunity"), F.col(f"{n}_0").alias("affected"), F.col(f"{n}_1").alias("denominator")) for n in parts]
    return counted.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


@query("agg_genre_distribution", "SELECT lang AS genre, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY lang")
def agg_genre_distribution(spark, sf_dir):
    c = P.read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("genre")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def provenance_rows(rows: DataFrame) -> DataFrame:
    """(metric, n, id): a row for each of ``rows`` (metric, id), with the count of its metric. No metric's ids are gathered."""
    counted = rows.groupBy(F.col("metric").alias("counted")).agg(F.count("*").alias("n"))
    return rows.join(counted, F.col("metric").eqNullSafe(F.col("counted"))).select("metric", "n", "id")


@query("agg_provenance_rows", "SELECT o_orderpriority AS metric, CAST(count(*) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS n, o_orderkey AS id FROM orders")
def agg_provenance_rows(spark, sf_dir):
    """From an aggregate back to all its rows."""
    return provenance_rows(P.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").alias("id")))


@query(
    "agg_version_comparison",
    """
WITH m AS (SELECT l_linestatus AS g, CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS n_lines FROM lineitem GROUP BY 1),
u AS (SELECT g, 'rows' AS metric, n_rows AS v FROM m UNION ALL SELECT g, 'lines', n_lines FROM m)
SELECT metric, max(v) FILTER (g = 'F') AS before, max(v) FILTER (g = 'O') AS after, max(v) FILTER (g = 'O') - max(v) FILTER (g = 'F') AS change FROM u GROUP BY metric""",
)
def agg_version_comparison(spark, sf_dir):
    """Metrics of two versions side by side with their absolute change."""
    m = P.read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count("*").cast("double").alias("rows"), F.count_distinct("l_orderkey").cast("double").alias("lines"))
    long = m.select("l_linestatus", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in ("rows", "lines")])).alias("x")).select("l_linestatus", "x.*")
    wide = long.groupBy("metric").pivot("l_linestatus", ["F", "O"]).max("v")
    return wide.select("metric", F.round("F", 4).alias("before"), F.round("O", 4).alias("after"), F.round(F.col("O") - F.col("F"), 4).alias("change"))


@query(
    "agg_gold_scope",
    """
SELECT CASE WHEN d.doc_id IS NULL THEN 'label_only' WHEN l.doc_id IS NULL THEN 'text_only' ELSE 'both' END AS scope, CAST(count(*) AS BIGINT) AS n
FROM documents d FULL JOIN (SELECT CASE WHEN doc_id % 10 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""",
)
def agg_gold_scope(spark, sf_dir):
    d = P.read(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("d"))
    l = P.read(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 10 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.lit(True).alias("l"))  # noqa: E741
    scope = F.when(F.col("d").isNull(), "label_only").when(F.col("l").isNull(), "text_only").otherwise("both")
    return d.join(l, "doc_id", "full_outer").groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))

"""Reconciled metrics of an evaluation: every count, rate and funnel from one scan of a ledger of candidates, with the rows behind each count.

A ledger's row is marked with all metrics that it counts for; one aggregation over ranges of ids makes bitmaps, whose cardinality is the count. Bitmaps of several ledgers, or of parts of one, are merged by OR, so a count can be traced to its rows without lists of ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query
from .addresses import _book
from .authorisation import _AUTHORISED, authorise, evidence_tables
from .ordering import with_ordinals

# The ledger's metrics, as conditions that both engines read.
_ORIGINS = {"parser": "origin = 'parser'", "extraction": "origin = 'extraction'"}
_SCORABLE = "gold_available AND state_mutated"
METRICS = {
    "mapped": "true",
    "spine_promoted": "disposition = 'promoted'",
    "spine_rejected": "disposition = 'rejected'",
    "spine_routed": "disposition = 'routed'",
    "legacy_attempted": "legacy_attempted",
    "legacy_applied": "legacy_disposition = 'applied'",
    "legacy_unresolved": "legacy_disposition = 'unresolved'",
    "applied_mutation": "state_mutated",
    "authoritative_promotion": "authority_promoted",
    "incorrect_applied": "state_mutated AND correctness = 'incorrect'",
    "incorrect_promoted": "authority_promoted AND correctness = 'incorrect'",
    "scorable": _SCORABLE,
    "verified_correct": f"{_SCORABLE} AND correctness = 'correct'",
    "verified_incorrect": f"{_SCORABLE} AND correctness = 'incorrect'",
    "unscored": "correctness = 'not_scorable'",
    **{f"{o}_mapped": c for o, c in _ORIGINS.items()},
    **{f"{o}_target_resolved": f"{c} AND target IS NOT NULL" for o, c in _ORIGINS.items()},
    **{f"{o}_{d}": f"{c} AND disposition = '{d}'" for o, c in _ORIGINS.items() for d in ("promoted", "rejected", "routed")},
    **{f"{o}_applied": f"{c} AND state_mutated" for o, c in _ORIGINS.items()},
    **{f"{o}_authoritative": f"{c} AND authority_promoted" for o, c in _ORIGINS.items()},
    **{f"{o}_scorable": f"{c} AND {_SCORABLE}" for o, c in _ORIGINS.items()},
    **{f"{o}_correct": f"{c} AND {_SCORABLE} AND correctness = 'correct'" for o, c in _ORIGINS.items()},
}
#: Rates: a metric over another one; null where that is 0.
RATES = {
    "spine_promotion_rate": ("spine_promoted", "mapped"),
    "incorrect_applied_rate": ("incorrect_applied", "applied_mutation"),
    "incorrect_promotion_rate": ("incorrect_promoted", "authoritative_promotion"),
    "precision": ("verified_correct", "scorable"),
    "parser_precision": ("parser_correct", "parser_scorable"),
    "extraction_precision": ("extraction_correct", "extraction_scorable"),
    "scorable_coverage": ("scorable", "mapped"),
}
#: What a family's inventory counts.
INVENTORY = {
    "total_count": "true",
    "parser_derived": _ORIGINS["parser"],
    "extraction_derived": _ORIGINS["extraction"],
    "spine_candidate": "target IS NOT NULL",
    "spine_promoted": METRICS["spine_promoted"],
    "spine_rejected": METRICS["spine_rejected"],
    "routed": METRICS["spine_routed"],
    "legacy_attempted": METRICS["legacy_attempted"],
    "legacy_applied": METRICS["legacy_applied"],
    "legacy_unresolved": METRICS["legacy_unresolved"],
    "gt_scorable": _SCORABLE,
    "verified_correct": METRICS["verified_correct"],
    "verified_incorrect": METRICS["verified_incorrect"],
}
#: The stages of a chain, each with what its ledger must have; a chain counts for a stage only if it has passed all before.
FUNNEL = {
    "total_chains": "true",
    "instructions_available": "n_mapped > 0",
    "target_resolved": "n_target > 0",
    "executable_available": "n_promoted + n_legacy_applied > 0",
    "successful_transition": "n_mutated > 0",
    "scorable": "n_scorable > 0",
    "no_incorrect": "n_incorrect = 0",
}


def provenance(ledger: DataFrame, id_column: str = "candidate", n: int | None = None) -> DataFrame:
    """(metric, bucket, rows): for each metric a bitmap of the ids it counts, one for each range of ids. Ids are whole numbers from 1, best without large gaps.

    Nulls count as false. The ledger is read once; a row's metrics are the bits of one number, and a range's rows make all its bitmaps together, so rows aren't
    multiplied and no metric is a hot group. Where the number ``n`` of rows is known, ranges are dealt over as many portions as that needs.
    """
    bits = {name: 1 << k for k, name in enumerate(METRICS)}
    marks = reduce(Column.bitwiseOR, [F.when(F.expr(c), F.lit(bits[m])).otherwise(F.lit(0)).cast("long") for m, c in METRICS.items()])
    each = ledger.select(F.bitmap_bucket_number(id_column).alias("bucket"), F.bitmap_bit_position(id_column).alias("bit"), marks.alias("marks"))
    each = each if n is None else each.repartition(P.portions_of(ledger.sparkSession, n), "bucket")
    ranges = each.groupBy("bucket").agg(*[F.expr(f"bitmap_construct_agg(bit) FILTER (WHERE marks & {b}L <> 0)").alias(m) for m, b in bits.items()])
    return ranges.select("bucket", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("rows")) for m in METRICS]))).where(F.bitmap_count("rows") > 0).select("metric", "bucket", "rows")


def merge_provenance(parts: DataFrame) -> DataFrame:
    """One bitmap for each metric and range, from those of several runs."""
    return parts.groupBy("metric", "bucket").agg(F.bitmap_or_agg("rows").alias("rows"))


def rows_behind(bitmaps: DataFrame, metric: str) -> DataFrame:
    """The ids behind one metric."""
    octets = F.transform(F.sequence(F.lit(1), F.length("rows")), lambda k: F.struct(k.alias("k"), F.conv(F.hex(F.substring(F.col("rows"), k, F.lit(1))), 16, 10).cast("int").alias("b")))
    one = bitmaps.where(F.col("metric") == metric).select("bucket", F.explode(F.filter(octets, lambda o: o["b"] > 0)).alias("o")).select("bucket", "o.*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    return one.where(F.expr("(b >> bit) & 1") == 1).select(((F.col("bucket") - 1) * 32768 + (F.col("k") - 1) * 8 + F.col("bit") + 1).alias("id"))


def metric_values(bitmaps: DataFrame) -> DataFrame:
    """(metric, n, denominator, rate): every metric with its count (0 where no row counts for it), and every rate with both its counts."""
    return _values(bitmaps.groupBy("metric").agg(F.sum(F.bitmap_count("rows")).alias("n")))


def ledger_metrics(ledger: DataFrame) -> DataFrame:
    """The same as ``metric_values`` from the ledger itself, whose rows need no ids then: equal rows are counted first, of which there are at most some thousand, and only these are measured."""
    alike = ledger.withColumn("target", F.when(F.col("target").isNotNull(), True)).groupBy(*MEASURED).agg(F.count("*").alias("n_"))
    row = alike.agg(*[F.coalesce(F.sum(F.when(F.expr(c), F.col("n_"))), F.lit(0).cast("long")).alias(n) for n, c in METRICS.items()])
    return _values(row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in METRICS]))))


def _values(counts: DataFrame) -> DataFrame:
    # a row for each metric, whatever the ledger's size: one struct of all counts
    whole = counts.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("metric", "n"))).alias("c"))
    count = lambda name: F.coalesce(F.try_element_at("c", F.lit(name)), F.lit(0).cast("long"))
    none = F.lit(None)
    plain = [F.struct(F.lit(m).alias("metric"), count(m).alias("n"), none.cast("long").alias("denominator"), none.cast("double").alias("rate")) for m in METRICS]
    rates = [F.struct(F.lit(r).alias("metric"), count(a).alias("n"), count(b).alias("denominator"), F.when(count(b) > 0, F.round(count(a) / count(b), 4)).alias("rate")) for r, (a, b) in RATES.items()]
    return whole.select(F.inline(F.array(*plain, *rates)))


def family_inventory(ledger: DataFrame) -> DataFrame:
    """Thirteen counts for each family; candidates without one are ``none``."""
    return ledger.groupBy(F.coalesce("family", F.lit("none")).alias("family")).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in INVENTORY.items()])


def chain_rows(ledger: DataFrame) -> DataFrame:
    """A row for each chain: its counts, and the first stage of FUNNEL that it doesn't reach (null if it reaches all)."""
    wanted = {"n_mapped": "true", "n_target": "target IS NOT NULL", "n_promoted": METRICS["spine_promoted"], "n_legacy_applied": METRICS["legacy_applied"], "n_mutated": "state_mutated", "n_scorable": _SCORABLE, "n_incorrect": METRICS["verified_incorrect"]}
    rows = ledger.groupBy("chain_id").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in wanted.items()])
    return rows.withColumn("first_failure", F.coalesce(*[F.when(~F.expr(c), n) for n, c in FUNNEL.items()]))


def chain_funnel(chains: DataFrame) -> DataFrame:
    """(position, stage, n): how many chains pass each stage and all before it."""
    stages, passed, held = [], F.lit(True), []
    for k, (name, condition) in enumerate(FUNNEL.items()):
        passed = passed & F.expr(condition)
        held.append(F.when(passed, F.lit(k)))
        stages.append(name)
    counts = chains.select(F.explode(F.array_compact(F.array(*held))).alias("position")).groupBy("position").agg(F.count("*").alias("n"))
    every = chains.sparkSession.createDataFrame(list(enumerate(stages)), "position int, stage string")
    return every.join(counts, "position", "left").select("position", "stage", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


_LEDGER = """
SELECT row_number() OVER (ORDER BY evidence_id) AS candidate, agreement_id AS chain_id, family, commitment_id AS target, CASE WHEN value_provenance = 'PARSER_EXTRACTED' THEN 'parser' ELSE 'extraction' END AS origin, {disposition} AS disposition,
  {attempted} AS legacy_attempted, CASE WHEN {attempted} THEN CASE WHEN step = 'value_provenance' THEN 'applied' ELSE 'unresolved' END END AS legacy_disposition, step IN ('authorized', 'value_provenance') AS state_mutated, step = 'authorized' AND confidence >= 95 AS authority_promoted,
  declared_old_value IS NOT NULL AS gold_available, CASE WHEN declared_old_value IS NULL THEN 'not_scorable' WHEN coalesce(canonical_key_hint = commitment_id, false) THEN 'correct' ELSE 'incorrect' END AS correctness FROM judged""".format(
    disposition="CASE WHEN step = 'authorized' THEN 'promoted' WHEN step IN ('target_identity', 'predecessor_lookup', 'old_value_consistency') THEN 'rejected' ELSE 'routed' END",
    attempted="(step <> 'authorized' AND commitment_id IS NOT NULL)",
)


#: What METRICS read of a ledger.
MEASURED = ("target", "origin", "disposition", "legacy_attempted", "legacy_disposition", "state_mutated", "authority_promoted", "gold_available", "correctness")


def candidate_ledger(spark, sf_dir) -> DataFrame:
    """The ledger of all evidence of ``eng_authorisations``: where each candidate ended, and whether that can be scored. Not numbered, see ``numbered``."""
    evidence, versions = evidence_tables(spark, sf_dir)
    c = F.col
    origin = F.when(c("value_provenance") == "PARSER_EXTRACTED", "parser").otherwise("extraction")
    more = evidence.withColumns({"origin": origin, "gold_available": c("declared_old_value").isNotNull(), "hint": c("canonical_key_hint")})
    done = authorise(more, _book(spark, sf_dir), versions, "evidence_id", ["kind", "origin", "gold_available", "hint"])
    tried = (c("step") != "authorized") & c("commitment_id").isNotNull()
    disposition = F.when(c("step") == "authorized", "promoted").when(c("step").isin("target_identity", "predecessor_lookup", "old_value_consistency"), "rejected").otherwise("routed")
    correct: Column = F.when(~c("gold_available"), "not_scorable").when(c("hint") == c("commitment_id"), "correct").otherwise("incorrect")
    return done.select(
        "evidence_id",
        c("agreement_id").alias("chain_id"),
        c("kind").alias("family"),
        c("commitment_id").alias("target"),
        "origin",
        disposition.alias("disposition"),
        tried.alias("legacy_attempted"),
        F.when(tried, F.when(c("step") == "value_provenance", "applied").otherwise("unresolved")).alias("legacy_disposition"),
        c("step").isin("authorized", "value_provenance").alias("state_mutated"),
        ((c("step") == "authorized") & (c("confidence") >= 95)).alias("authority_promoted"),
        "gold_available",
        correct.alias("correctness"),
    )


def numbered(ledger: DataFrame, n: int | None = None) -> DataFrame:
    """What metrics read of a ledger (of ``n`` rows, if known), with candidates numbered in the order of their evidence: ids for bitmaps. Counts alone don't need them."""
    return with_ordinals(ledger, "evidence_id", name="candidate", kept=MEASURED, n=n)


_WITH = _AUTHORISED + f", ledger AS ({_LEDGER})\n"
_TABLES = "address_given evidence kernel_version"
_MEMBERS = "m AS (SELECT unnest([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in METRICS.items()) + "]) AS metric, candidate FROM ledger)"
_NAMES = "names AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in METRICS) + "]) AS metric)"


@query(
    "agg_evaluation_metrics",
    _WITH
    + f", {_MEMBERS}, {_NAMES}, c AS (SELECT metric, CAST(count(candidate) AS BIGINT) AS n FROM names LEFT JOIN m USING (metric) GROUP BY 1)\nSELECT metric, n, CAST(NULL AS BIGINT) AS denominator, CAST(NULL AS DOUBLE) AS rate FROM c UNION ALL "
    + " UNION ALL ".join(f"SELECT '{r}', x.n, y.n, CASE WHEN y.n > 0 THEN round(x.n / y.n, 4) END FROM c x, c y WHERE x.metric = '{a}' AND y.metric = '{b}'" for r, (a, b) in RATES.items()),
    _TABLES,
)
def agg_evaluation_metrics(spark, sf_dir):
    """All metrics and rates of the candidates' ledger."""
    return ledger_metrics(candidate_ledger(spark, sf_dir))


@query("agg_metric_provenance", _WITH + f", {_MEMBERS} SELECT metric, (candidate - 1) // 32768 + 1 AS bucket, CAST(count(*) AS BIGINT) AS n FROM m WHERE metric IS NOT NULL GROUP BY ALL", _TABLES)
def agg_metric_provenance(spark, sf_dir):
    """How many rows each bitmap of each metric has."""
    n = evidence_tables(spark, sf_dir)[0].count()
    return provenance(numbered(candidate_ledger(spark, sf_dir), n), n=n).select("metric", "bucket", F.bitmap_count("rows").alias("n"))


@query("agg_family_counters", _WITH + "SELECT coalesce(family, 'none') AS family, " + ", ".join(f"CAST(count(*) FILTER ({c}) AS BIGINT) AS {n}" for n, c in INVENTORY.items()) + " FROM ledger GROUP BY 1", _TABLES)
def agg_family_counters(spark, sf_dir):
    """The inventory of transformation families: thirteen counts each."""
    return family_inventory(candidate_ledger(spark, sf_dir))


_CHAIN_SQL = ", ch AS (SELECT chain_id, count(*) AS n_mapped, count(*) FILTER (target IS NOT NULL) AS n_target, count(*) FILTER (disposition = 'promoted') AS n_promoted, count(*) FILTER (legacy_disposition = 'applied') AS n_legacy_applied, count(*) FILTER (state_mutated) AS n_mutated, count(*) FILTER (gold_available AND state_mutated) AS n_scorable, count(*) FILTER (gold_available AND state_mutated AND correctness = 'incorrect') AS n_incorrect FROM ledger GROUP BY 1)\n"


@query("agg_chain_funnel", _WITH + _CHAIN_SQL + " UNION ALL ".join(f"SELECT {k} AS position, '{n}' AS stage, CAST(count(*) FILTER ({' AND '.join(list(FUNNEL.values())[: k + 1])}) AS BIGINT) AS n FROM ch" for k, n in enumerate(FUNNEL)), _TABLES)
def agg_chain_funnel(spark, sf_dir):
    """How many chains pass each stage and all stages before it."""
    return chain_funnel(chain_rows(candidate_ledger(spark, sf_dir)))


@query("agg_chain_first_failure", _WITH + _CHAIN_SQL + "SELECT CASE " + " ".join(f"WHEN NOT ({c}) THEN '{n}'" for n, c in FUNNEL.items()) + " ELSE 'none' END AS first_failure, CAST(count(*) AS BIGINT) AS n FROM ch GROUP BY 1", _TABLES)
def agg_chain_first_failure(spark, sf_dir):
    """The first stage that chains don't reach."""
    rows = chain_rows(candidate_ledger(spark, sf_dir))
    return rows.groupBy(F.coalesce("first_failure", F.lit("none")).alias("first_failure")).agg(F.count("*").alias("n"))

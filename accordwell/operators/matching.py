"""One-to-one matching of detected instructions with annotated ones, as a greedy matcher that takes the best pair first would do it.

A pair that is the best of both its sides will be taken whatever else is, so all such pairs are taken at once, and the pairs that
they rule out go; this is repeated until no pair is left. Ties are ordered by the sides' ids, so the result is the sequential one.

Spans compete only within one document and type. Such a group is matched where its spans are, so that spans are shuffled and not
pairs; groups with very many pairs go by rounds over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query
from ..storage import materialise
from .ordering import with_ordinals


def greedy_matching(pairs: DataFrame, left: str = "gold_id", right: str = "detected_id", score: str = "score") -> DataFrame:
    """The pairs that a sequential greedy matcher takes, by ``score`` from the highest, then ``left``, then ``right`` from the smallest. Ids are unique over all groups; null scores take no part.

    Each round is two aggregations, combined before their shuffle. Rounds are as many as the longest chain of pairs that each give way to a better one.
    """
    columns = pairs.columns
    order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    left_, taken = materialise(pairs.where(F.col(score).isNotNull()).dropDuplicates([left, right])), []
    while not left_.isEmpty():
        best = lambda side: left_.groupBy(side).agg(F.min(order).alias(f"best_{side}"))  # noqa: E731, B023
        ranked = left_.join(best(left), left).join(best(right), right)
        chosen = materialise(ranked.where((order == F.col(f"best_{left}")) & (order == F.col(f"best_{right}"))).select(*columns))
        taken.append(chosen)
        left_ = materialise(left_.join(chosen.select(left), left, "left_anti").join(chosen.select(right), right, "left_anti"))
    return reduce(DataFrame.unionAll, taken) if taken else pairs.limit(0)


def span_pairs(gold: DataFrame, detected: DataFrame, width: int = 512) -> DataFrame:
    """(document_id, gold_id, detected_id, score) of what may match: the same type, and spans that intersect, scored by what they share over what they cover.

    ``gold``: document_id, gold_id, instruction_type, target_ref, b, e (the span; null if there is none); ``detected`` likewise with detected_id. Spans meet in buckets of ``width``
    characters; of the buckets that a pair shares only the first gives it. Annotations without a span go by target_ref, with score 0.
    """
    cut = lambda rows, name: rows.where("b < e").select("document_id", "instruction_type", f"{name}_id", F.col("b").alias(f"b_{name}"), F.col("e").alias(f"e_{name}"), F.explode(F.sequence(F.floor(F.col("b") / width), F.floor((F.col("e") - 1) / width))).alias("bucket"))
    low, high = F.greatest("b_gold", "b_detected"), F.least("e_gold", "e_detected")
    met = cut(gold, "gold").join(cut(detected, "detected"), ["document_id", "instruction_type", "bucket"]).where((low < high) & (F.col("bucket") == F.floor(low / width)))
    covered = F.greatest("e_gold", "e_detected") - F.least("b_gold", "b_detected")
    spans = met.select("document_id", "gold_id", "detected_id", ((high - low).cast("double") / covered).alias("score"))
    bare = gold.where("b is null or e is null").join(detected.select("document_id", "instruction_type", "target_ref", "detected_id"), ["document_id", "instruction_type", "target_ref"])
    return spans.unionAll(bare.select("document_id", "gold_id", "detected_id", F.lit(0.0)))


GROUP = ["document_id", "instruction_type"]
MOST_PAIRS, MOST_SPANS = 1 << 20, 1 << 16  # of a group that one task matches; larger ones go by rounds
_MATCH = pa.schema([("document_id", pa.int64()), ("gold_id", pa.int64()), ("detected_id", pa.int64()), ("score", pa.float64())])


def _pairs(gold: np.ndarray, b: np.ndarray, e: np.ndarray, known: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of both sides and score of every pair of a group, as ``span_pairs`` has them."""
    spans = known & (b < e)
    g, d = np.flatnonzero(gold & spans), np.flatnonzero(~gold & spans)
    low, high = np.maximum(b[g][:, None], b[d]), np.minimum(e[g][:, None], e[d])
    i, j = np.nonzero(low < high)
    covered = np.maximum(e[g[i]], e[d[j]]) - np.minimum(b[g[i]], b[d[j]])
    score = (high[i, j] - low[i, j]).astype("float64") / covered
    bare, every = np.flatnonzero(gold & ~known & (ref >= 0)), np.flatnonzero(~gold)
    k, m = np.nonzero(ref[bare][:, None] == ref[every]) if len(bare) else (np.empty(0, "int64"),) * 2
    return np.concatenate([g[i], bare[k]]), np.concatenate([d[j], every[m]]), np.concatenate([score, np.zeros(len(k))])


def _match_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of groups that follow one another; only the last group of a batch waits for the next. Spans without a column ``id`` stand in order and are known by their places."""

    def matched(table: pa.Table) -> tuple[pa.RecordBatch, int]:
        """Matches of all groups but the last, and where that begins."""
        code = lambda name: pc.fill_null(pc.dictionary_encode(table[name].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        whole = lambda name: pc.fill_null(pc.cast(table[name], pa.int64()), 0).to_numpy()
        doc, kind, ref, b, e = table["document_id"].to_numpy(), code("instruction_type"), code("target_ref"), whole("b"), whole("e")
        ids = whole("id") if "id" in table.column_names else np.arange(table.num_rows)
        gold = table["gold"].to_numpy()
        known = pc.and_(pc.is_valid(table["b"]), pc.is_valid(table["e"])).to_numpy()
        ends = [0, *(np.flatnonzero((doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()]
        out = []
        for a, z in zip(ends, ends[1:]):
            if not 0 < (n := np.count_nonzero(gold[a:z])) < z - a:
                continue
            own = ids[a:z]
            left, right, score = _pairs(gold[a:z], b[a:z], e[a:z], known[a:z], ref[a:z])
            best = np.lexsort((own[right], own[left], -score))
            used: set[int] = set()
            for g, d, s in zip(left[best].tolist(), right[best].tolist(), score[best].tolist()):
                if g not in used and d not in used:
                    used.update((g, d))
                    out.append((doc[a], own[g], own[d], s))
                    n -= 1
                    if not n:
                        break
        columns = zip(*out) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCH)], schema=_MATCH), ends[-1]

    held = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            found, begin = matched(table)
            held = table.slice(begin)
            yield found
    if held is not None:
        closing = pa.table({n: pa.concat_arrays([held[n].combine_chunks(), pa.array([-1 - held["document_id"][0].as_py() if n == "document_id" else True if n == "gold" else None], held[n].type)]) for n in held.column_names})
        yield matched(closing)[0]


def match_spans(gold: DataFrame, detected: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The matches that ``greedy_matching`` makes of ``span_pairs``, with one shuffle of spans and no pair shuffled, whatever number of rounds that would take. Ids are whole numbers, each unique.

    With ``order``, spans have no ids but these columns, by which they would be numbered: matches are then known by document and score only.
    """
    own_id = lambda name: order or [F.col(name).alias("id")]
    side = lambda rows, name, own: rows.where("document_id is not null and instruction_type is not null").select(*GROUP, F.lit(own).alias("gold"), *own_id(name), "target_ref", "b", "e")
    spans = side(gold, "gold_id", True).unionAll(side(detected, "detected_id", False))
    sizes = spans.groupBy(*GROUP).agg(F.count_if("gold").alias("g"), F.count("*").alias("n"))
    is_large = (F.col("g") * (F.col("n") - F.col("g")) > MOST_PAIRS) | (F.col("n") > MOST_SPANS)
    whole = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(is_large).alias("large")).first()
    if not whole.large:
        return _in_groups(spans, whole.n, order)
    large = materialise(sizes.where(is_large).select(*GROUP))
    of = lambda rows, how: rows.join(large, GROUP, how)
    if order:
        all_large = with_ordinals(of(spans, "left_semi"), *order, name="id")
        sides = [all_large.where(F.col("gold") == own).withColumnRenamed("id", name) for own, name in ((True, "gold_id"), (False, "detected_id"))]
    else:
        sides = [of(gold, "left_semi"), of(detected, "left_semi")]
    rest = _in_groups(of(spans, "left_anti"), whole.n, order)
    return rest.unionAll(greedy_matching(span_pairs(*sides)).select(*rest.columns))


def _in_groups(spans: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    placed = spans.repartition(P.portions_of(spans.sparkSession, n), *GROUP).sortWithinPartitions(*GROUP, *order).drop(*order)
    found = placed.mapInArrow(_match_groups, "document_id long, gold_id long, detected_id long, score double")
    return found.select("document_id", "score") if order else found


def match_counts(gold: DataFrame, detected: DataFrame, matches: DataFrame) -> DataFrame:
    """(document_id, tp, fp, fn) of every document that has annotations or detections."""
    tags = matches.select("document_id", F.lit(1).alias("tp"), F.lit(0).alias("g"), F.lit(0).alias("d"))
    every = tags.unionAll(gold.select("document_id", F.lit(0), F.lit(1), F.lit(0))).unionAll(detected.select("document_id", F.lit(0), F.lit(0), F.lit(1)))
    return every.groupBy("document_id").agg(F.sum("tp").alias("tp"), (F.sum("d") - F.sum("tp")).alias("fp"), (F.sum("g") - F.sum("tp")).alias("fn"))


P.SQL["annotation"] = """
SELECT l_orderkey // 30 AS document_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id, l_returnflag AS instruction_type, concat('Section ', CAST(l_partkey % 5 AS VARCHAR)) AS target_ref,
  CASE WHEN l_partkey % 9 > 0 OR l_linenumber > 3 THEN CAST(l_partkey * 7 % 3000 AS INTEGER) END AS b, CAST(l_partkey * 7 % 3000 + CAST(l_quantity AS INTEGER) * 40 AS INTEGER) AS e, l_linenumber <= 3 AS gold FROM lineitem"""


_IN_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def _sides(lines: DataFrame, *known: Column | str) -> tuple[DataFrame, DataFrame]:
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    start = (p * 7 % 3000).cast("int")
    s = lines.select(
        F.expr("l_orderkey DIV 30").alias("document_id"),
        *known,
        F.col("l_returnflag").alias("instruction_type"),
        F.concat(F.lit("Section "), (p % 5).cast("string")).alias("target_ref"),
        F.when((p % 9 > 0) | (n > 3), start).alias("b"),
        (start + F.col("l_quantity").cast("int") * 40).alias("e"),
        (n <= 3).alias("gold"),
    )
    return s.where("gold").drop("gold"), s.where("not gold").drop("gold")


def annotation(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Annotated and detected spans that compete for one another, some annotations without a span."""
    lines = P.read(spark, sf_dir, "lineitem").select(*_IN_LINE, "l_returnflag", "l_quantity")
    gold, detected = _sides(with_ordinals(lines, *_IN_LINE, name="id", kept=("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"), n=lines.count()), "id")
    return gold.withColumnRenamed("id", "gold_id"), detected.withColumnRenamed("id", "detected_id")


def annotation_in_line(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same without ids, with the columns that ids would follow: what only counts needs no numbers over all spans."""
    return _sides(P.read(spark, sf_dir, "lineitem"), *_IN_LINE)


_MATCHED = """
WITH RECURSIVE pairs AS (
  SELECT g.document_id, g.id AS gold_id, d.id AS detected_id, CASE WHEN g.b IS NULL THEN 0.0::DOUBLE ELSE CAST(least(g.e, d.e) - greatest(g.b, d.b) AS DOUBLE) / (greatest(g.e, d.e) - least(g.b, d.b)) END AS score
  FROM annotation g JOIN annotation d ON g.gold AND NOT d.gold AND g.document_id = d.document_id AND g.instruction_type = d.instruction_type
    AND CASE WHEN g.b IS NULL THEN g.target_ref = d.target_ref ELSE g.b < d.e AND d.b < g.e END),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, gold_id, detected_id) AS n FROM pairs),
t AS (
  SELECT document_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS gold_id, CAST(NULL AS BIGINT) AS detected_id, CAST(NULL AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT document_id FROM o)
  UNION ALL
  SELECT o.document_id, o.n, CASE WHEN free THEN o.gold_id END, CASE WHEN free THEN o.detected_id END, o.score, CASE WHEN free THEN list_concat(used, [o.gold_id, o.detected_id]) ELSE used END
  FROM (SELECT o.*, t.used, NOT list_contains(t.used, o.gold_id) AND NOT list_contains(t.used, o.detected_id) AS free FROM t JOIN o ON o.document_id = t.document_id AND o.n = t.n + 1) o)
"""


@query("map_greedy_gold_match", _MATCHED + "SELECT document_id, gold_id, detected_id, score FROM t WHERE gold_id IS NOT NULL", "annotation")
def map_greedy_gold_match(spark, sf_dir):
    """One-to-one matches of annotated and detected spans, the best pair first; ``map_span_gold_match`` stops after one round."""
    return match_spans(*annotation(spark, sf_dir))


@query(
    "agg_gold_match_counts",
    _MATCHED + "SELECT document_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(d) - sum(tp) AS BIGINT) AS fp, CAST(sum(g) - sum(tp) AS BIGINT) AS fn FROM (SELECT document_id, 1 AS tp, 0 AS g, 0 AS d FROM t WHERE gold_id IS NOT NULL UNION ALL SELECT document_id, 0, CAST(gold AS INT), CAST(NOT gold AS INT) FROM annotation) GROUP BY 1",
    "annotation",
)
def agg_gold_match_counts(spark, sf_dir):
    """True and false positives and misses of each document, from the greedy matches."""
    gold, detected = annotation_in_line(spark, sf_dir)
    return match_counts(gold, detected, match_spans(gold, detected, _IN_LINE))

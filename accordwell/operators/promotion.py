"""Provisional successors of commitments: staged, promoted, discarded, rolled back.

A writer stages a successor upon the version it has seen, and may promote it only while that version is the current one: of several
writers that stage upon the same version one wins. A successor may be a tombstone. A rollback takes the last version back.
A commitment's operations are read in order, past a small state; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..functions.columns import python_values
from ..registry import query

OPERATION = "commitment_id long, seq long, op string, writer string, expected int, entry long, tombstone boolean"
RESULT = "commitment_id long, seq long, op string, outcome string, version int, current long, deleted boolean"


def _apply(versions: list[tuple[int, bool]], staged: dict[str, tuple[int, int, bool]], op: dict) -> str:
    """One operation on the versions so far (entry and tombstone of each) and the writers' staged successors; its outcome."""
    writer, now = op["writer"], len(versions)
    if op["op"] == "STAGE":
        if op["expected"] is not None and op["expected"] != now:
            return "stale"
        staged[writer] = (now, op["entry"], bool(op["tombstone"]))
        return "staged"
    if op["op"] == "ROLLBACK":
        if not now:
            return "nothing"
        versions.pop()
        return "rolled back"
    held = staged.pop(writer, None)
    if held is None:
        return "nothing"
    if op["op"] == "DISCARD":
        return "discarded"
    if held[0] != now:
        return "conflict"
    versions.append(held[1:])
    return "promoted"


def _run(batches: Iterator[pa.RecordBatch], ends: bool = False) -> Iterator[pa.RecordBatch]:
    """A row for each operation; with ``ends`` only the last of each key."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RESULT.split(", ")])
    names, key = [c.split()[0] for c in OPERATION.split(", ")], None
    versions: list[tuple[int, bool]] = []
    staged: dict[str, tuple[int, int, bool]] = {}
    op, outcome = None, ""

    def row() -> tuple:
        entry, deleted = versions[-1] if versions else (None, None)
        return key, op["seq"], op["op"], outcome, len(versions), entry, deleted

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        rows = []
        for values in zip(*map(python_values, batch.columns)):
            if values[0] != key:
                if ends and op is not None:
                    rows.append(row())
                key, versions, staged = values[0], [], {}
            op = dict(zip(names, values))
            outcome = _apply(versions, staged, op)
            if not ends:
                rows.append(row())
        if rows:
            yield made(rows)
    if ends and op is not None:
        yield made([row()])


def replay(operations: DataFrame) -> DataFrame:
    """The outcome of each operation (STAGE, PROMOTE, DISCARD, ROLLBACK) in the order of ``seq`` for each commitment, with the version, entry and tombstone that are current after it.

    STAGE with ``expected`` fails (stale) unless that is the current version's number, 0 before there is any; a writer's later stage replaces the earlier. PROMOTE is a conflict if the version
    changed since the stage. Equal ``seq`` are taken in the order of the other columns.
    """
    return _in_order(operations).mapInArrow(_run, RESULT)


def replay_to_ends(operations: DataFrame) -> DataFrame:
    """The rows of ``replay`` for the last operation of each commitment; only these leave the tasks."""
    return _in_order(operations).mapInArrow(partial(_run, ends=True), RESULT)


def _in_order(operations: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in OPERATION.split(", ")]
    full = operations.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in OPERATION.split(", ")])
    return full.repartition("commitment_id").sortWithinPartitions(*names)


def snapshot(results: DataFrame, seq: int | None = None) -> DataFrame:
    """(commitment_id, version, current) after all operations up to ``seq``; commitments without a version, or whose version is a tombstone, are left out."""
    seen = results if seq is None else results.where(F.col("seq") <= seq)
    last = seen.groupBy("commitment_id").agg(F.max_by(F.struct("version", "current", "deleted"), "seq").alias("s"))
    return last.where("s.version > 0 and not s.deleted").select("commitment_id", "s.version", "s.current")


P.SQL["kernel_operation"] = """
SELECT l_suppkey AS commitment_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq,
  CASE WHEN l_partkey % 9 < 4 THEN 'STAGE' WHEN l_partkey % 9 < 7 THEN 'PROMOTE' WHEN l_partkey % 9 = 7 THEN 'DISCARD' ELSE 'ROLLBACK' END AS op, concat('w', CAST(l_orderkey % 3 AS VARCHAR)) AS writer,
  CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey % 4 AS INTEGER) END AS expected, l_orderkey * 8 + l_linenumber AS entry, l_linenumber = 5 AS tombstone FROM lineitem"""


def kernel_operation(spark, sf_dir) -> DataFrame:
    """Three writers that stage, promote and discard in turn, and rollbacks."""
    from pyspark.sql import Window as W

    c = F.col
    m = c("l_partkey") % 9
    return P.read(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("commitment_id"),
        F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("seq"),
        F.when(m < 4, "STAGE").when(m < 7, "PROMOTE").when(m == 7, "DISCARD").otherwise("ROLLBACK").alias("op"),
        F.concat(F.lit("w"), (c("l_orderkey") % 3).cast("string")).alias("writer"),
        F.when(c("l_linenumber") == 1, c("l_orderkey") % 4).alias("expected"),
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("entry"),
        (c("l_linenumber") == 5).alias("tombstone"),
    )


_REPLAY = """
WITH RECURSIVE f AS (
  SELECT commitment_id, CAST(0 AS BIGINT) AS seq, '' AS op, '' AS outcome, CAST([] AS STRUCT(entry BIGINT, tombstone BOOLEAN)[]) AS versions, CAST([] AS STRUCT(writer VARCHAR, base BIGINT, entry BIGINT, tombstone BOOLEAN)[]) AS staged
  FROM (SELECT DISTINCT commitment_id FROM kernel_operation)
  UNION ALL
  SELECT commitment_id, seq, op, outcome,
    CASE outcome WHEN 'promoted' THEN list_append(versions, {'entry': mine.entry, 'tombstone': mine.tombstone}) WHEN 'rolled back' THEN versions[:-2] ELSE versions END,
    CASE WHEN outcome = 'staged' THEN list_append(others, {'writer': writer, 'base': len(versions), 'entry': entry, 'tombstone': tombstone}) WHEN op IN ('PROMOTE', 'DISCARD') THEN others ELSE staged END
  FROM (SELECT *, CASE op WHEN 'STAGE' THEN CASE WHEN expected IS NOT NULL AND expected <> len(versions) THEN 'stale' ELSE 'staged' END WHEN 'ROLLBACK' THEN CASE WHEN len(versions) = 0 THEN 'nothing' ELSE 'rolled back' END
      WHEN 'DISCARD' THEN CASE WHEN mine IS NULL THEN 'nothing' ELSE 'discarded' END ELSE CASE WHEN mine IS NULL THEN 'nothing' WHEN mine.base <> len(versions) THEN 'conflict' ELSE 'promoted' END END AS outcome
    FROM (SELECT o.*, f.versions, f.staged, list_filter(f.staged, lambda s: s.writer = o.writer)[-1] AS mine, list_filter(f.staged, lambda s: s.writer <> o.writer) AS others
      FROM f JOIN kernel_operation o ON o.commitment_id = f.commitment_id AND o.seq = f.seq + 1)))
"""


@query(
    "tmp_promotion_log",
    _REPLAY + "SELECT commitment_id, seq, op, outcome, CAST(len(versions) AS INTEGER) AS version, versions[-1].entry AS current, versions[-1].tombstone AS deleted FROM f WHERE seq > 0",
    "kernel_operation",
)
def tmp_promotion_log(spark, sf_dir):
    """What came of every stage, promotion, discard and rollback."""
    return replay(kernel_operation(spark, sf_dir))


@query(
    "tmp_promotion_snapshot",
    _REPLAY + "SELECT commitment_id, CAST(len(versions) AS INTEGER) AS version, versions[-1].entry AS current FROM f WHERE len(versions) > 0 AND NOT versions[-1].tombstone QUALIFY row_number() OVER (PARTITION BY commitment_id ORDER BY seq DESC) = 1 AND seq = (SELECT max(seq) FROM kernel_operation o WHERE o.commitment_id = f.commitment_id)",
    "kernel_operation",
)
def tmp_promotion_snapshot(spark, sf_dir):
    """The current version of every commitment that has one and isn't deleted."""
    ends = replay_to_ends(kernel_operation(spark, sf_dir))
    return ends.where("version > 0 and not deleted").select("commitment_id", "version", "current")

"""Section addresses of commitments and the registries that map texts and sections to commitments.

Addresses resolve exactly, then where the query is the beginning of an address, then where an address is the beginning of the query; both
old and new addresses of a renumbered commitment go on resolving. Prefixes become keys of equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query


def address_book(registrations: DataFrame, renumberings: DataFrame) -> DataFrame:
    """(agreement_id, ref, commitment_id, old, seq) of all addresses that resolve.

    ``registrations``: agreement_id, section_ref, commitment_id, seq. ``renumberings``: agreement_id, commitment_id, new_ref, seq (later than the registrations).
    An address that is given again belongs to the last commitment, at the place of the first. A renumbered commitment's former addresses are ``old``.
    """
    known = registrations.select("agreement_id", "commitment_id").distinct()
    moves = renumberings.join(known, ["agreement_id", "commitment_id"], "left_semi")
    given = registrations.select("agreement_id", F.col("section_ref").alias("ref"), "commitment_id", "seq").unionAll(moves.select("agreement_id", F.col("new_ref").alias("ref"), "commitment_id", "seq"))
    current = given.groupBy("agreement_id", "ref").agg(F.max_by("commitment_id", "seq").alias("commitment_id"), F.min("seq").alias("seq"))
    # what each commitment was called before each of its renumberings
    own = W.partitionBy("agreement_id", "commitment_id").orderBy("seq")
    steps = given.withColumn("former", F.lag("ref").over(own)).join(moves.select("agreement_id", "commitment_id", "seq").distinct(), ["agreement_id", "commitment_id", "seq"], "left_semi")
    old = steps.where("former is not null").groupBy("agreement_id", F.col("former").alias("ref")).agg(F.max_by("commitment_id", "seq").alias("commitment_id"), F.min("seq").alias("seq"))
    columns = ("agreement_id", "ref", "commitment_id", "old", "seq")
    return current.withColumn("old", F.lit(0)).select(*columns).unionAll(old.withColumn("old", F.lit(1)).select(*columns))


def _beginnings(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n))


def resolve_addresses(asked: DataFrame, book: DataFrame) -> DataFrame:
    """(agreement_id, section_ref, commitment_id, tier) of the references that resolve. ``asked``: agreement_id, section_ref.

    Tiers: 1 the same address, 2 an address begins with the reference, 3 the reference begins with an address; 2 and 3 without regard to case and outer
    spaces of the reference. Within a tier current addresses come before old ones, then the first given. Null and empty references don't resolve.
    """
    refs = asked.where("section_ref <> ''").select("agreement_id", "section_ref").distinct().withColumn("q", F.lower(F.trim("section_ref"))).where("q <> ''")
    place = F.struct("old", "seq")
    best = F.struct("tier", "old", "seq")
    exact = refs.join(book.select("agreement_id", F.col("ref").alias("section_ref"), "commitment_id", "old", "seq"), ["agreement_id", "section_ref"]).withColumn("tier", F.lit(1))
    low = book.where("ref <> ''").withColumn("low", F.lower("ref"))
    # one row for each beginning of any address: the address that would be chosen
    first = lambda rows: rows.agg(F.min_by(F.struct("commitment_id", "old", "seq"), place).alias("x"))
    begun = first(low.select("agreement_id", F.explode(_beginnings(F.col("low"))).alias("q"), "commitment_id", "old", "seq").groupBy("agreement_id", "q"))
    inside = refs.join(begun, ["agreement_id", "q"]).select("agreement_id", "section_ref", "q", "x.*", F.lit(2).alias("tier"))
    whole = first(low.select("agreement_id", F.col("low").alias("part"), "commitment_id", "old", "seq").groupBy("agreement_id", "part"))
    parts = refs.withColumn("part", F.explode(_beginnings(F.col("q"))))
    around = parts.join(whole, ["agreement_id", "part"]).select("agreement_id", "section_ref", "q", "x.*", F.lit(3).alias("tier"))
    columns = ("agreement_id", "section_ref", "commitment_id", "old", "seq", "tier")
    every = exact.select(*columns).unionAll(inside.select(*columns)).unionAll(around.select(*columns))
    return every.groupBy("agreement_id", "section_ref").agg(F.min_by(F.struct("commitment_id", "tier"), best).alias("x")).select("agreement_id", "section_ref", "x.*")


P.SQL["address_given"] = """
SELECT o_custkey % 30 AS agreement_id, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Section ' ELSE 'section ' END, '7.', CAST(o_orderkey % 23 AS VARCHAR), CASE o_orderkey % 4 WHEN 0 THEN '(a)' WHEN 1 THEN '(a)(i)' WHEN 2 THEN '' ELSE '(b)' END) AS section_ref,
  concat('c', CAST(o_custkey % 17 AS VARCHAR)) AS commitment_id, o_orderkey AS seq, o_orderkey % 5 = 0 AS moved FROM orders"""
P.SQL["address_asked"] = """
SELECT DISTINCT l_suppkey % 30 AS agreement_id, concat(CASE WHEN l_partkey % 3 = 0 THEN ' SECTION ' ELSE 'Section ' END, '7.', CAST(l_partkey % 25 AS VARCHAR), CASE l_linenumber WHEN 1 THEN '(a)' WHEN 2 THEN '(A)' WHEN 3 THEN '(a)(i)(x)' WHEN 4 THEN '(c)' ELSE '' END) AS section_ref FROM lineitem"""


def address_given(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word, tail = F.when(k % 2 == 0, "Section ").otherwise("section "), F.when(k % 4 == 0, "(a)").when(k % 4 == 1, "(a)(i)").when(k % 4 == 2, "").otherwise("(b)")
    return P.read(spark, sf_dir, "orders").select(
        (c % 30).alias("agreement_id"),
        F.concat(word, F.lit("7."), (k % 23).cast("string"), tail).alias("section_ref"),
        F.concat(F.lit("c"), (c % 17).cast("string")).alias("commitment_id"),
        k.alias("seq"),
        (k % 5 == 0).alias("moved"),
    )


def address_asked(spark, sf_dir) -> DataFrame:
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    tail = F.when(n == 1, "(a)").when(n == 2, "(A)").when(n == 3, "(a)(i)(x)").when(n == 4, "(c)").otherwise("")
    ref = F.concat(F.when(p % 3 == 0, " SECTION ").otherwise("Section "), F.lit("7."), (p % 25).cast("string"), tail)
    return P.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("agreement_id"), ref.alias("section_ref")).distinct()


_BOOK = """
WITH r AS (SELECT * FROM address_given WHERE NOT moved),
given AS (SELECT agreement_id, section_ref AS ref, commitment_id, seq, false AS moved FROM r
  UNION ALL SELECT agreement_id, concat(section_ref, '-new'), commitment_id, seq + 1000000000000, true FROM address_given WHERE moved AND (agreement_id, commitment_id) IN (SELECT (agreement_id, commitment_id) FROM r)),
book AS (SELECT agreement_id, ref, arg_max(commitment_id, seq) AS commitment_id, 0 AS old, min(seq) AS seq FROM given GROUP BY 1, 2
  UNION ALL SELECT agreement_id, former, arg_max(commitment_id, seq), 1, min(seq) FROM (SELECT *, lag(ref) OVER (PARTITION BY agreement_id, commitment_id ORDER BY seq) AS former FROM given) WHERE moved AND former IS NOT NULL GROUP BY 1, 2)
"""


def _book(spark, sf_dir) -> DataFrame:
    given = address_given(spark, sf_dir)
    registrations = given.where("not moved")
    moves = given.where("moved").select("agreement_id", "commitment_id", F.concat("section_ref", F.lit("-new")).alias("new_ref"), (F.col("seq") + 1000000000000).alias("seq"))
    return address_book(registrations, moves)


@query("map_address_book", _BOOK + "SELECT agreement_id, ref, commitment_id, old, seq FROM book", "address_given")
def map_address_book(spark, sf_dir):
    """Every address that resolves, current and renumbered."""
    return _book(spark, sf_dir)


@query(
    "map_resolve_address",
    _BOOK
    + """, m AS (SELECT a.agreement_id, a.section_ref, b.commitment_id, b.old, b.seq, CASE WHEN b.ref = a.section_ref THEN 1 WHEN starts_with(lower(b.ref), lower(trim(a.section_ref))) THEN 2 ELSE 3 END AS tier
  FROM address_asked a JOIN book b ON b.agreement_id = a.agreement_id AND (b.ref = a.section_ref OR starts_with(lower(b.ref), lower(trim(a.section_ref))) OR starts_with(lower(trim(a.section_ref)), lower(b.ref))))
SELECT agreement_id, section_ref, commitment_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY agreement_id, section_ref ORDER BY tier, old, seq) AS rn FROM m) WHERE rn = 1""",
    "address_given address_asked",
)
def map_resolve_address(spark, sf_dir):
    """Exact addresses, then addresses that begin with the reference, then addresses that the reference begins with."""
    return resolve_addresses(address_asked(spark, sf_dir), _book(spark, sf_dir))

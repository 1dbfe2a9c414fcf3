"""The domain tables (agreements, versions, instructions, edges, copies) as projections of source tables.

Every projection exists twice: as a DataFrame, and as SQL that another engine can run on the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, portions: int = 4) -> DataFrame:
    """Narrow ``rows`` dealt over all cores by ``keys``, ``portions`` for each, before costly work on each row; how many splits a file has doesn't matter then."""
    return rows.repartition(portions * rows.sparkSession.sparkContext.defaultParallelism, *keys)


MOST_ROWS = 250_000  # that a task is to sort


def portions_of(spark: SparkSession, n: int) -> int:
    """In how many portions ``n`` rows are sorted: one for each core at least, and so many that what a task holds stays the same however many rows there are."""
    return max(spark.sparkContext.defaultParallelism, -(-n // MOST_ROWS))


SQL: dict[str, str] = {}

SQL["agreement"] = "SELECT c_custkey AS agreement_id, c_name AS issuer_name FROM customer"


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agreement_id"), F.col("c_name").alias("issuer_name"))


SQL["agreement_version"] = """
SELECT o_orderkey AS agreement_version_id, o_custkey AS agreement_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version_number,
       o_orderdate AS effective_at,
       CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
            THEN 'ORIGINAL' ELSE 'AMENDMENT' END AS kind
FROM orders"""


def agreement_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("agreement_version_id"),
        F.col("o_custkey").alias("agreement_id"),
        number.alias("version_number"),
        F.col("o_orderdate").alias("effective_at"),
        F.when(number == 1, "ORIGINAL").otherwise("AMENDMENT").alias("kind"),
    )


SQL["commitment_version"] = """
SELECT o_orderkey AS version_id, o_custkey AS agreement_id, o_orderpriority AS canonical_key,
       lag(o_orderkey) OVER k AS parent_version_id,
       CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'WAIVED' ELSE 'SUSPENDED' END AS status,
       o_orderdate AS valid_from, lead(o_orderdate) OVER k AS valid_to,
       CAST(row_number() OVER k AS INTEGER) AS version_number, o_totalprice AS threshold
FROM orders WINDOW k AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)"""


def status_of(code: Column) -> Column:
    return F.when(code == "F", "ACTIVE").when(code == "O", "WAIVED").otherwise("SUSPENDED")


def commitment_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window per key: parent, end of validity and number come from a single sort."""
    key = W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("agreement_id"),
        F.col("o_orderpriority").alias("canonical_key"),
        F.lag("o_orderkey").over(key).alias("parent_version_id"),
        status_of(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("valid_from"),
        F.lead("o_orderdate").over(key).alias("valid_to"),
        F.row_number().over(key).alias("version_number"),
        F.col("o_totalprice").alias("threshold"),
    )


SQL["amendment_instruction"] = """
SELECT l_orderkey AS amendment_version_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS INTEGER) AS instruction_order,
       CASE l_returnflag WHEN 'R' THEN 'REPLACE_VALUE' WHEN 'A' THEN 'ADD' ELSE 'UNRESOLVED' END AS instruction_type,
       CASE l_linestatus WHEN 'F' THEN 'APPLIED' ELSE 'UNRESOLVED' END AS status,
       concat('Section 7.', CAST(l_linenumber AS VARCHAR)) AS target_section_ref,
       CAST(l_linenumber AS VARCHAR) AS target_key,
       l_quantity AS old_value, l_extendedprice AS new_value, l_shipdate AS effective_start,
       1 - l_discount AS parser_confidence
FROM lineitem"""


def amendment_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("amendment_version_id"),
        order.alias("instruction_order"),
        F.when(F.col("l_returnflag") == "R", "REPLACE_VALUE").when(F.col("l_returnflag") == "A", "ADD").otherwise("UNRESOLVED").alias("instruction_type"),
        F.when(F.col("l_linestatus") == "F", "APPLIED").otherwise("UNRESOLVED").alias("status"),
        F.concat(F.lit("Section 7."), F.col("l_linenumber").cast("string")).alias("target_section_ref"),
        F.col("l_linenumber").cast("string").alias("target_key"),
        F.col("l_quantity").alias("old_value"),
        F.col("l_extendedprice").alias("new_value"),
        F.col("l_shipdate").alias("effective_start"),
        (1 - F.col("l_discount")).alias("parser_confidence"),
    )


SQL["representation"] = """
SELECT o_orderkey AS representation_id, o_custkey AS agreement_id, o_orderpriority AS canonical_key,
       CASE WHEN o_orderkey % 2 = 0 THEN 'risk_model' ELSE 'summary' END AS representation_type,
       o_orderdate + INTERVAL 30 DAY AS observed_at,
       CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice - 1 ELSE o_totalprice END AS stated_threshold
FROM orders WHERE o_orderkey % 3 <> 0"""


def representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of commitments elsewhere: some keys have none, some state another value."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    return o.select(
        F.col("o_orderkey").alias("representation_id"),
        F.col("o_custkey").alias("agreement_id"),
        F.col("o_orderpriority").alias("canonical_key"),
        F.when(F.col("o_orderkey") % 2 == 0, "risk_model").otherwise("summary").alias("representation_type"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("observed_at"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")).alias("stated_threshold"),
    )


SQL["instruction_stream"] = """
SELECT user_id AS agreement_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step,
       event_id, ts AS effective_at, concat('k', CAST(event_id % 7 AS VARCHAR)) AS target_key,
       CASE event_type WHEN 'signup' THEN 'ADD_COMMITMENT' WHEN 'click' THEN 'REPLACE_VALUE'
            WHEN 'view' THEN 'RENUMBER_REFERENCE' WHEN 'purchase' THEN 'WAIVE_TEMPORARILY' ELSE 'UNRESOLVED' END AS instruction_type,
       value AS new_value
FROM events"""

INSTRUCTION_OF_EVENT = {"signup": "ADD_COMMITMENT", "click": "REPLACE_VALUE", "view": "RENUMBER_REFERENCE", "purchase": "WAIVE_TEMPORARILY"}


def instruction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("UNRESOLVED")
    for event, instruction in INSTRUCTION_OF_EVENT.items():
        kind = F.when(F.col("event_type") == event, instruction).otherwise(kind)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("agreement_id"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"),
        "event_id",
        F.col("ts").alias("effective_at"),
        F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("target_key"),
        kind.alias("instruction_type"),
        F.col("value").alias("new_value"),
    )


SQL["chain_step"] = """
SELECT conv_id AS chain_id, turn AS amendment_number, role,
       CASE role WHEN 'user' THEN 'APPLIED' WHEN 'assistant' THEN 'RESOLVING' ELSE 'UNRESOLVED' END AS outcome,
       CAST(length(text) AS BIGINT) AS size
FROM conversations"""


def chain_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chain_id"),
        F.col("turn").alias("amendment_number"),
        "role",
        F.when(F.col("role") == "user", "APPLIED").when(F.col("role") == "assistant", "RESOLVING").otherwise("UNRESOLVED").alias("outcome"),
        F.length("text").cast("long").alias("size"),
    )


SQL["clause"] = """
SELECT o_orderkey AS document_id,
       concat('Section 7.', CAST(o_orderkey % 12 + 1 AS VARCHAR), ' of the Credit Agreement is hereby ',
         CASE o_orderkey % 6
           WHEN 0 THEN concat('amended by deleting "', CAST(o_custkey AS VARCHAR), '.50 to 1.00" and substituting "', CAST(o_custkey % 9 + 1 AS VARCHAR), '.25 to 1.00" in lieu thereof')
           WHEN 1 THEN 'amended and restated in its entirety to read as follows: The Borrower shall maintain a Leverage Ratio'
           WHEN 2 THEN concat('amended by adding the following new clause: Capital Expenditures shall not exceed $', CAST(o_custkey AS VARCHAR), ',000,000')
           WHEN 3 THEN 'deleted in its entirety'
           WHEN 4 THEN concat('waived until June 30, ', CAST(2020 + o_orderkey % 7 AS VARCHAR), ' at a rate of ', CAST(o_custkey % 9 AS VARCHAR), '.75%')
           ELSE 'modified by the parties on September 31, 2023 subject to a minimum Interest Coverage Ratio' END, '.') AS text
FROM orders"""


def clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause texts made of columns, so that parsers have something to find."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    body = (
        F.when(key % 6 == 0, F.concat(F.lit('amended by deleting "'), s(cust), F.lit('.50 to 1.00" and substituting "'), s(cust % 9 + 1), F.lit('.25 to 1.00" in lieu thereof')))
        .when(key % 6 == 1, "amended and restated in its entirety to read as follows: The Borrower shall maintain a Leverage Ratio")
        .when(key % 6 == 2, F.concat(F.lit("amended by adding the following new clause: Capital Expenditures shall not exceed $"), s(cust), F.lit(",000,000")))
        .when(key % 6 == 3, "deleted in its entirety")
        .when(key % 6 == 4, F.concat(F.lit("waived until June 30, "), s(key % 7 + 2020), F.lit(" at a rate of "), s(cust % 9), F.lit(".75%")))
        .otherwise("modified by the parties on September 31, 2023 subject to a minimum Interest Coverage Ratio")
    )
    text = F.concat(F.lit("Section 7."), s(key % 12 + 1), F.lit(" of the Credit Agreement is hereby "), body, F.lit("."))
    return read(spark, sf_dir, "orders").select(key.alias("document_id"), text.alias("text"))

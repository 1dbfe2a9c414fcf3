"""Sources and sinks: delimited files, JSON, whole texts, manifests and validated tables.

Schemas are declared, never inferred from data. Reading is permissive and reports what is wrong in a column; writing is
strict and refuses a table with invalid rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ISSUERS = "issuer_name string, cik string, form string"
FILINGS = "accession string, form string, filed date, document string"
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("artifact_path", "sha256", "artifact_type", "created_at")] + [T.StructField("mutable", T.BooleanType())])
#: Domain tables as they are stored.
SCHEMAS = {
    "agreement": "agreement_id string, issuer_cik string, issuer_name string, agreement_name string, executed_at date, created_at timestamp_ntz",
    "source_document": "document_id string, agreement_id string, sha256 string, url string, fetched_at timestamp_ntz, text string",
    "agreement_version": "agreement_version_id string, agreement_id string, version_number int, kind string, prior_version_id string, effective_at timestamp_ntz",
    "source_span": "span_id string, document_id string, start_offset int, end_offset int, locator variant",
    "commitment": "commitment_id string, agreement_id string, canonical_key string",
    "commitment_version": "version_id string, commitment_id string, parent_version_id string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, party array<string>, "
    "modality string, action string, subject string, operator string, threshold double, unit string, frequency string, deadline string, rate double, scope variant, exceptions array<string>, confidence double",
    "amendment_instruction": "instruction_id string, amendment_version_id string, instruction_order int, instruction_type string, status string, target_key string, target_section_ref string, field string, "
    "old_value struct<num:double,str:string,arr:array<string>,obj:variant>, new_value struct<num:double,str:string,arr:array<string>,obj:variant>, effective_start timestamp_ntz, effective_end timestamp_ntz, parser_confidence double",
    "lineage_edge": "edge_id string, from_version_id string, to_version_id string, edge_type string, authority_document_id string",
    "reference_change": "change_id string, agreement_id string, old_ref string, new_ref string, effective_at timestamp_ntz",
    "downstream_representation": "representation_id string, agreement_id string, representation_type string, observed_at timestamp_ntz",
    "representation_commitment": "representation_id string, canonical_key string, stated_value variant",
    "propagation_check": "check_id string, representation_id string, status string, diff variant",
    "validation_task": "task_id string, target_id string, priority int, status string",
    "validation_decision": "decision_id string, task_id string, decision string, decided_at timestamp_ntz",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def read_issuers(spark: SparkSession, path: str) -> DataFrame:
    """Issuers from CSV; rows without a cik are no issuers."""
    return spark.read.schema(ISSUERS).csv(path, header=True).where("trim(cik) <> ''")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, content hash and whole text."""
    files = spark.read.format("text").option("wholetext", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("sha256"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def filings_of(payloads: DataFrame) -> DataFrame:
    """Filings from JSON whose fields are parallel arrays: (cik, json) to a row per filing."""
    arrays = F.from_json("json", "accession array<string>, form array<string>, filed array<string>")
    return payloads.select("cik", arrays.alias("a")).select("cik", F.explode(F.arrays_zip("a.accession", "a.form", "a.filed")).alias("f")).select(
        "cik", F.col("f.accession").alias("accession"), F.col("f.form").alias("form"), F.to_date("f.filed").alias("filed")
    )


def errors_of(rows: DataFrame, tests: dict[str, str]) -> DataFrame:
    """Adds ``errors``: the names of the tests (SQL conditions that hold for bad rows) that a row fails."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.expr(t), n) for n, t in tests.items()])))


def write_validated(rows: DataFrame, tests: dict[str, str], path: str) -> None:
    """Writes Parquet, or raises if any row fails a test; nothing is written then."""
    bad = errors_of(rows, tests).where("size(errors) > 0")
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"invalid row: {first[0].asDict()}")
    rows.write.mode("overwrite").parquet(path)


def write_execution(tables: dict[str, DataFrame], path: str, amendment: str) -> None:
    """The tables of one amendment, each in a partition of its own that a repeated run replaces as a whole."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/amendment={amendment}")


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Entries whose hash is missing or another: artifact_path, sha256, actual, verdict. Reads only."""
    now = found.select(F.col("path").alias("artifact_path"), F.col("sha256").alias("actual"))
    verdict = F.when(F.col("actual").isNull(), "missing").when(F.col("sha256") != F.col("actual"), "changed").otherwise("same")
    return manifest.join(now, "artifact_path", "left").select("artifact_path", "sha256", "actual", verdict.alias("verdict"))


class FilingSearch(DataSource):
    """Paged full-text search as a source: ``spark.read.format("filing_search")``.

    Options: ``pages`` (number of pages), ``per_page``, and ``endpoint``. Without an endpoint, pages are made up, so that the
    source works where there is no network; with one, each page is a task of its own that asks again up to ``retries`` times.
    """

    @classmethod
    def name(cls) -> str:
        return "filing_search"

    def schema(self) -> str:
        return "page int, position int, accession string, form string"

    def reader(self, schema: T.StructType) -> "FilingSearchReader":
        return FilingSearchReader(dict(self.options))


class FilingSearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, size = partition.value, int(self.options.get("per_page", 10))
        if endpoint := self.options.get("endpoint"):
            import json
            import time
            from urllib.request import urlopen

            tries = int(self.options.get("retries", 3))
            for k in range(tries):
                try:
                    with urlopen(f"{endpoint}?from={page * size}", timeout=30) as answer:
                        hits = json.load(answer)["hits"]
                    break
                except OSError:
                    if k == tries - 1:
                        raise
                    time.sleep(2**k)
            for i, hit in enumerate(hits):
                yield page, i, hit["accession"], hit["form"]
        else:
            for i in range(size):
                n = page * size + i
                yield page, i, f"{n:010d}-{n % 100:02d}-{n:06d}", "8-K" if n % 3 else "10-Q"

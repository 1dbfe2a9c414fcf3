"""Sources, sinks and the streaming fold."""

import json

import pytest
from pyspark.sql import functions as F

from accordwell.sources import files
from accordwell.streaming import instructions

SF = "/root/testdata/sf0.001"


def test_issuers_without_cik_are_left_out(spark, tmp_path):
    (tmp_path / "i.csv").write_text("issuer_name,cik,form\nA,1,8-K\nB,,8-K\nC, ,10-Q\n")
    assert [r.issuer_name for r in files.read_issuers(spark, str(tmp_path / "i.csv")).collect()] == ["A"]


def test_parallel_arrays_become_filings(spark):
    payload = json.dumps({"accession": ["a", "b"], "form": ["8-K", "10-Q"], "filed": ["2023-01-02", "2023-02-03"]})
    got = files.filings_of(spark.createDataFrame([("1", payload)], "cik string, json string")).collect()
    assert [(r.accession, r.form, str(r.filed)) for r in got] == [("a", "8-K", "2023-01-02"), ("b", "10-Q", "2023-02-03")]


def test_texts_and_manifest(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    texts = files.read_texts(spark, str(tmp_path / "t"))
    row = texts.first()
    assert row.text == "one\ntwo"
    manifest = spark.createDataFrame([(row.path, row.sha256, "text", "now", False), ("gone", "x", "text", "now", False), (row.path, "y", "text", "now", False)], files.MANIFEST)
    assert sorted(r.verdict for r in files.verify_manifest(manifest, texts).collect()) == ["changed", "missing", "same"]
    (tmp_path / "m.json").write_text('[{"artifact_path": "p", "sha256": "s", "mutable": false}]')
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first().artifact_path == "p"


def test_writing_refuses_invalid_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, -1)], "id int, n int")
    with pytest.raises(ValueError):
        files.write_validated(rows, {"negative": "n < 0"}, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    files.write_validated(rows.where("n > 0"), {"negative": "n < 0"}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_a_repeated_amendment_replaces_its_own_rows(spark, tmp_path):
    t = lambda n: {"applied": spark.range(n), "unresolved": spark.range(1)}
    files.write_execution(t(3), str(tmp_path), "a1")
    files.write_execution(t(2), str(tmp_path), "a2")
    files.write_execution(t(4), str(tmp_path), "a1")
    assert spark.read.parquet(str(tmp_path / "applied")).groupBy("amendment").count().orderBy("amendment").collect()[0]["count"] == 4


def test_search_source(spark):
    spark.dataSource.register(files.FilingSearch)
    got = spark.read.format("filing_search").option("pages", 3).option("per_page", 4).load()
    assert got.count() == 12 and got.select("accession").distinct().count() == 12


@pytest.mark.parametrize("name", sorted(files.SCHEMAS))
def test_schemas_are_valid(spark, name):
    assert files.empty_table(spark, name).columns


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    for _, part in events.toPandas().groupby(lambda i: i // 400):
        spark.createDataFrame(part, schema=instructions.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = instructions.fold_stream(instructions.as_instructions(instructions.read_events(spark, str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("folded").collect():
        last[r.agreement_id, r.target_key] = max(last.get((r.agreement_id, r.target_key), (0, "", 0.0)), (r.applied + r.unresolved, str(r.status), r.value if r.value == r.value else None), key=lambda x: x[0])
    from accordwell import projections as P
    from accordwell.operators.state import fold_instructions

    batch = fold_instructions(P.instruction_stream(spark, SF)).collect()
    assert len(batch) == len(last)
    for r in batch:
        n, status, value = last[r.agreement_id, r.target_key]
        assert (r.applied + r.unresolved, str(r.status), r.value) == (n, status, value)


def test_windowed_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    counts = instructions.windowed_counts(instructions.read_events(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_stream_of_all_types_equals_batch(spark, tmp_path):
    from accordwell.operators import execution

    rows = execution.full_instruction(spark, SF).where("agreement_id <= 3").withColumn("step", F.col("step").cast("long")).persist()
    cut = rows.approxQuantile("step", [0.4, 0.7], 0)
    for k, where in enumerate((f"step <= {cut[0]}", f"step > {cut[0]} and step <= {cut[1]}", f"step > {cut[1]}")):
        rows.where(where).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    q = instructions.execute_stream(stream).writeStream.format("memory").queryName("executed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = ("agreement_id", "target_key", "step", "outcome", "action", "status")
    got = sorted(tuple(str(x) for x in r) for r in spark.table("executed").select(*key).collect())
    assert got and got == sorted(tuple(str(x) for x in r) for r in execution.execute(rows).select(*key).collect())

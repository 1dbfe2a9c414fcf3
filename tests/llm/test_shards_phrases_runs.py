"""Shards, collocations and periodic runs against brute force, and their awkward cases."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from accordwell.llm import collocations as C  # noqa: E402
from accordwell.llm import queries, runs, sharding  # noqa: E402

from ..test_oracles import DATA, TABLES, rows  # noqa: E402

DOCS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, DATA), con.execute(queries.ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows(mine.columns, mine.collect()) == rows(names, theirs.fetchall())


# ---- shards


def test_a_new_shard_takes_rows_only_into_itself_and_weights_are_shares(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k").withColumn("shard", F.lit("clash"))
    weights = [1.0, 2.0, 1.0, 0.0]
    before = sharding.with_shards(ids, "k", weights)
    after = sharding.with_shards(ids, "k", [*weights, 1.0]).withColumnRenamed("shard", "grown")
    both = before.join(after, "k").groupBy("shard", "grown").count().collect()
    assert all(r.grown in (r.shard, 4) for r in both)
    share = collections.Counter()
    for r in both:
        share[r.shard] += r["count"] / 20_000
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02 and share[3] == 0
    moved = sum(r["count"] for r in both if r.grown == 4) / 20_000
    assert abs(moved - 0.2) < 0.02
    # a shard that goes gives its rows away, no other row moves
    without = sharding.with_shards(ids, "k", [1.0, 0.0, 1.0]).withColumnRenamed("shard", "less")
    assert before.join(without, "k").where("shard <> 1 and shard <> less").isEmpty()
    with pytest.raises(ValueError):
        sharding.with_shards(ids, "k", [0.0])


def test_shards_of_awkward_rows(spark):
    """Null ids and texts, an id and whole rows that repeat, one row that is a third of all, columns with clashing names."""
    some = [(1, "a", "x"), (1, "b", "x"), (None, None, None), (2, "", "y"), *[(7, "hot", "z")] * 700, *[(k, "é" * (k % 40), "n") for k in range(100, 1500)]]
    docs = spark.createDataFrame(some, DOCS).withColumns({"shard": F.lit("s"), "slot": F.lit(1), "size": F.lit(2), "law": F.lit(0)}).repartition(9)
    got = sharding.shard_digests(docs, 8).collect()
    assert len(got) == len(some) and sum(r.size for r in got) == sum(len((t or "").encode()) + 16 for _, t, _ in some)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.text_crc32 for r in got if r.doc_id == 7} == {zlib.crc32(b"hot")}
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.shard_digests(docs.limit(0)).count() == 0
    few = sharding.with_slots(docs.select("doc_id", F.lit(0).alias("shard")), buckets=2, portion=100)
    assert sorted(r.slot for r in few.collect()) == list(range(len(some)))


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", "en") for k in range(300)], DOCS)
    sharding.write_shards(docs, str(tmp_path / "out"), "doc_id", [1.0] * 4, rows=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "lang").collect())) == sorted(map(tuple, docs.collect()))
    assert back.join(sharding.with_shards(docs, "doc_id", [1.0] * 4).withColumnRenamed("shard", "own"), "doc_id").where("shard <> own").isEmpty()


# ---- collocations


def phrases_by_force(docs, least, covered, longest):
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    out = []
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        cuts = [(10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(lg == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w))) and 100 * b >= covered * a for (lg, w), b in candidates.items())
        out.append((lang, words, a, counts[lang, words[:k]], counts[lang, words[k:]], total[lang], score, not inside))
    return sorted(out)


@pytest.mark.parametrize(("longest", "shard", "least"), [(3, 1 << 24, 3), (4, 150, 2), (2, 60, 2)])
def test_collocations_equal_brute_force(spark, longest, shard, least):
    rng = random.Random(longest)
    words = ["a", "b", "c", "É", "New", "york", "x y", "\0", "ß"]
    docs = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "fr", None, "und"])) for k in range(80)]
    docs += [(900, None, "en"), (901, "", None), (902, "New York. " * 30, "de"), (903, "lone", "xx")] + docs[:3]
    got = C.collocations(spark.createDataFrame(docs, DOCS).withColumns({"word": F.lit(1), "p1": F.lit(2), "f": F.lit("q")}).repartition(5), least, 50, longest, shard=shard)
    assert sorted((r.lang, tuple(r.words), r.a, r.l, r.r, r.n, r.score, r.kept) for r in got.collect()) == phrases_by_force(docs, least, 50, longest)


def test_top_collocations_break_ties_by_bytes(spark):
    kind = "lang string, words array<string>, a long, l long, r long, n long, score long, kept boolean"
    some = [("en", [w, "z"], 5, 5, 5, 9, 10, True) for w in ("é", "b", "a", "Z")] + [("en", ["c", "z"], 6, 6, 6, 9, 10, True), ("en", ["top"], 9, 9, 9, 9, 99, False), ("fr", ["q", "q"], 1, 1, 1, 1, 1, True)]
    got = [(r.lang, r.rank, r.phrase) for r in C.top_collocations(spark.createDataFrame(some, kind), 4).orderBy("lang", "rank").collect()]
    assert got == [("en", 1, "c z"), ("en", 2, "Z z"), ("en", 3, "a z"), ("en", 4, "b z"), ("fr", 1, "q q")]


def test_no_phrases_and_a_very_long_text(spark):
    empty = spark.createDataFrame([], DOCS)
    assert C.top_collocations(C.collocations(empty)).count() == 0
    long = "one two three " * 200_000
    got = {tuple(r.words): r for r in C.collocations(spark.createDataFrame([(1, long, "en")], DOCS)).collect()}
    assert (got["one", "two"].a, got["one", "two"].n) == (200_000, 600_000) and got["three", "one"].a == 199_999


def test_counts_beyond_64_bits_stay_exact(spark):
    """The score's products with counts near 10**12."""
    a, l, r = 999_999_999_989, 1_000_000_000_039, 1_000_000_000_061
    wide = "CAST({} AS DECIMAL(13, 0))".format
    got = spark.sql(f"select (({wide(a)} * {wide(a)}) * 1000000) DIV ({wide(l)} * {wide(r)}) AS s").first().s
    assert got == 10**6 * a * a // (l * r)


def test_words_that_share_a_hash_are_an_error():
    batch = pa.RecordBatch.from_pydict({"p1": [5, 5], "f": [1, 1], "lang": ["en", "en"], "word": ["a", "b"]})
    with pytest.raises(ValueError, match="seed"):
        list(C._merge(1, 1)(iter([batch])))
    with pytest.raises(ValueError, match="seed"):
        list(C._merge(1, 1)(iter([batch.slice(0, 1), batch.slice(1)])))
    same = pa.RecordBatch.from_pydict({"p1": [5, 5, 6], "f": [1, 2, 1], "lang": ["en"] * 3, "word": ["a", "a", "b"]})
    out = pa.Table.from_batches(list(C._merge(1, 3)(iter([same.slice(0, 1), same.slice(1)]))))
    assert out.to_pydict() == {"p1": [5], "f": [3], "lang": ["en"], "word": ["a"]}


def test_a_bitmap_has_all_its_nodes(spark):
    nodes = spark.range(5000).select(F.xxhash64("id").alias("p1"), F.xxhash64(F.col("id") + 7).alias("p2"))
    path = [np.array(c, np.int64).view(np.uint64) for c in zip(*nodes.collect())]
    bitmap = C.admitting_bitmap(nodes, ["p1", "p2"], 20)
    assert C._admitted(bitmap, path).all() and len(bitmap) == 2**20 // 64
    others = [np.random.default_rng(k).integers(0, 2**63, 5000, dtype=np.uint64) for k in (1, 2)]
    assert C._admitted(bitmap, others).mean() < 0.02


# ---- periodic runs


def runs_by_force(ids):
    out = {}
    for p in range(1, len(ids) // 2 + 1):
        i = 0
        while i + p < len(ids):
            j = i
            while j + p < len(ids) and ids[j] == ids[j + p]:
                j += 1
            if j - i + p >= max(12, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    documents = []
    for _ in range(600):
        n, k = rng.randrange(160), rng.choice([1, 2, 2, 3, 6])
        ids = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            ids = ids[:a] + [ids[min(n - 1, a + i % p)] for i in range(n - a)]
        documents.append(list(map(str, ids)))
    for words, found in zip(documents, runs.runs_of_documents(documents)):
        want = runs_by_force(words)
        assert list(map(tuple, found.tolist())) == want
        keep = [i for i in range(len(words)) if not any(s + p <= i < s + n for s, n, p in want)]
        assert np.flatnonzero(runs.kept_words(len(words), found)).tolist() == keep


def test_long_runs_of_many_forms():
    word = lambda n: [f"w{i}" for i in range(n)]
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    cases = [["x"] * 5000, word(700) * 3, word(5) + word(40) * 9 + word(3), (["a"] * 30 + ["b"]) * 20, fibonacci[1][:900]]
    for words in cases:
        assert list(map(tuple, runs.find_runs(np.unique(words, return_inverse=True)[1]).tolist())) == runs_by_force(words)


def test_documents_with_awkward_texts(spark):
    """Null, empty and wordless texts, repeated rows, a clashing column, a null id, a text of two megabytes; the query's form and the operator's own."""
    long = "alpha beta gamma " * 120_000
    some = [(1, None, None), (2, "", None), (3, " \t\n", None), (4, "x " * 12, None), (4, "x " * 12, None), (5, "x " * 11, None), (None, "a b c " * 5, None), (6, long, None), (7, "one two three four", None)]
    docs = spark.createDataFrame(some, DOCS).withColumn("n_runs", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in runs.periodic_runs(docs).collect():
        got[r.doc_id].append((r.n_runs, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")] and got[4] == [(1, [(0, 12, 1)], "x")] * 2 and got[5] == [(0, [], "x " * 10 + "x")]
    assert got[None] == [(1, [(0, 15, 3)], "a b c")] and got[6] == [(1, [(0, 360_000, 3)], "alpha beta gamma")] and got[7][0][2] == "one two three four"
    digests = {r.doc_id: r for r in runs.run_digests(docs, None).collect()}
    assert (digests[6].start, digests[6].length, digests[6].period, digests[6].exponent_milli) == (0, 360_000, 3, 120_000_000)
    assert digests[1].start is None and digests[1].runs_sha256 == digests[7].runs_sha256 != digests[4].runs_sha256
    assert runs.run_digests(docs.limit(0)).count() == 0


def test_planted_words():
    """The rule of the contract, word by word."""
    words, hit = [str(k) for k in range(50)], 0
    for doc_id in range(200):
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = math.floor(h / 10)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        want = words if h % 10 else [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert runs.planted(doc_id, words) == want
        hit += want != words
    assert hit and runs.planted(5, []) == [] and runs.planted(None, words) == words

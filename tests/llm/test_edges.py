"""Models against plain forms of themselves, and the awkward cases: long texts, repeated ids, clashing columns, hot keys, huge numbers."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from accordwell.llm import ann, chat, common, langid, neardup, packing, piece_bpe, quality, subwords, substring, toxicity  # noqa: E402

from .test_operators import DOCS, ODD, PIECES, SF, WORD_BPE, classes_by_force, documents, removed_by_force, words_of  # noqa: E402

LONG = " ".join(f"long{k % 5000} text" for k in range(120_000))  # 1.5 MB


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- models against plain forms


def plain_quality(model, text):
    """The average of all features' vectors, one after another, and a softmax."""
    vectors, words = [], text.split()
    for k, w in enumerate(words):
        flat, _ = subwords.subword_features([w], quality.BITS, quality.LEAST, quality.MOST)
        vectors += [model.vectors[f] for f in flat]
        if k and words[k - 1] == w:
            vectors.append(model.vectors[quality.REPEAT])
    mean = np.mean(vectors, axis=0) if vectors else np.zeros(model.vectors.shape[1])
    logits = model.output @ mean + model.bias
    e = np.exp(logits - logits.max())
    return e[1] / e.sum()


def test_quality_scores_equal_a_plain_forward_pass(spark):
    model = quality.SubwordClassifier(seed=1)
    model.bias[:] = [0.3, -0.2]
    texts = ODD + [" ".join(words_of(300, 9, 40)), LONG[:30_000]]
    got = {r.doc_id: r for r in quality.score_quality(documents(spark, texts, extra=True), model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i].score - plain_quality(model, t or "")) < 1e-5
        assert got[i].predicted == (got[i].score >= 0.3)


def test_quality_learns_by_gradient_descent():
    texts = ["good fine words", "bad poor words"] * 20
    model = quality.SubwordClassifier().fit(quality.document_features(texts), np.array([1, 0] * 20), epochs=20)
    assert plain_quality(model, "good fine") > 0.9 > 0.1 > plain_quality(model, "bad poor")


def plain_odds(model, text):
    """The logarithm of the sum of the exponentials of the distinct words' scores, each a scaled sum of weights."""
    scores = []
    for w in toxicity.distinct_words(text):
        flat, _ = subwords.subword_features([w], toxicity.BITS, toxicity.LEAST, toxicity.MOST)
        scores.append(sum(model.weights[f] for f in flat) / len(flat) ** 0.5)
    return float(np.logaddexp.reduce(scores)) + model.bias


def risk(model, positives, unlabelled):
    """The corrected risk, with the negatives' part as it is."""
    p, u = (np.array([plain_odds(model, t) for t in texts]) for texts in (positives, unlabelled))
    return model.prior * np.logaddexp(0, -p).mean(), np.logaddexp(0, u).mean() - model.prior * np.logaddexp(0, p).mean()


@pytest.mark.parametrize("bias", [0.2, -6.0])
def test_gradient_is_that_of_the_risk(bias):
    positives, unlabelled = ["you awful thing", "awful awful word here"], ["a kind word", "some thing", "one more text of words"]
    model = toxicity.PositiveUnlabelled(0.9 if bias < 0 else 0.3)
    model.weights[:] = np.random.default_rng(2).normal(0, 0.3, len(model.weights))
    model.bias = bias
    words = sorted({w for t in positives + unlabelled for w in toxicity.distinct_words(t)})
    features, counts = subwords.subword_features(words, toxicity.BITS, toxicity.LEAST, toxicity.MOST)
    starts = np.cumsum(counts) - counts
    docs = [(features, starts, counts, np.array([words.index(w) for w in toxicity.distinct_words(t)])) for t in positives + unlabelled]
    grad, by_doc = model.gradient(docs, len(positives))
    negative = risk(model, positives, unlabelled)[1] < 0  # then that part's gradient is taken backwards
    total = lambda: -risk(model, positives, unlabelled)[1] if negative else sum(risk(model, positives, unlabelled))

    def slope(change):
        change(1e-5)
        up = total()
        change(-2e-5)
        down = total()
        change(1e-5)
        return (up - down) / 2e-5

    def bias_by(d):
        model.bias += d

    def weight_by(k):
        def change(d):
            model.weights[k] += d

        return change

    assert abs(by_doc.sum() - slope(bias_by)) < 1e-6
    for k in np.argsort(-np.abs(grad))[:6]:
        assert abs(grad[k] - slope(weight_by(k))) < 1e-6


def test_toxicity_scores_equal_a_plain_forward_pass(spark):
    model = toxicity.PositiveUnlabelled(0.2)
    model.weights[:] = np.random.default_rng(4).normal(0, 1, len(model.weights))
    model.bias = -0.4
    texts = ODD + [" ".join(words_of(300, 9)), "Same words same WORDS", LONG[:20_000]]
    got = {r.doc_id: r for r in toxicity.score_toxicity(documents(spark, texts, extra=True), model).collect()}
    for i, t in enumerate(texts):
        want = 1 / (1 + np.exp(-plain_odds(model, t))) if toxicity.distinct_words(t or "") else 0
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (got[i].score >= 0.5)


def test_toxicity_on_documents_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity_model(docs, labels)
    known = labels.where(common.held_out(F.col("doc_id")))
    got = toxicity.score_toxicity(docs.join(known.select("doc_id"), "doc_id"), model).join(known, "doc_id").toPandas()
    assert got.held_out.all()
    caught = got[got.predicted == 1]
    assert (caught.toxic == 1).mean() > 0.9 and caught.toxic.sum() / got.toxic.sum() > 0.75


# ---- samples and joins


def test_fit_sample_counts_repeated_rows_once(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("t"))
    assert common.fit_sample(df, 2000, 2000, "k", "t").count() == 50  # k fixes t
    assert common.fit_sample(df.limit(0), 10, 0, "k").count() == 0
    some = common.fit_sample(spark.range(20_000), 1000, 20_000, "id")
    assert 850 < some.count() < 1150 and some.columns == ["hash_", "id"]
    assert common.fit_in_task(some, lambda rows: rows.num_rows) == some.count()
    assert common.fit_in_task(some.limit(0), lambda rows: rows.num_rows) == 0


def test_join_some_hot_is_a_left_join(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") < 3000, 1).when(F.col("id") < 3010, None).otherwise(F.col("id") % 100).alias("k"))
    counts = left.where("k is not null").groupBy("k").count().where("k <> 7").select("k", F.col("count").alias("n"), (F.col("k") * 2).alias("v"))
    got = {r.id: r.v for r in common.join_some_hot(left, counts, ["k"], 5000).collect()}
    assert got == {r.id: None if r.k in (None, 7) else 2 * r.k for r in left.collect()}


def test_portions_cover_every_row():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 100, "", "c" * 3] * 3})
    parts = list(common.portions(batch, 0, rows=4, size=50))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) <= 4 and parts[0].num_rows == 2


# ---- long texts, repeated rows, empty tables


def test_operators_on_a_very_long_text(spark):
    import sentencepiece

    docs = documents(spark, [LONG, "short text", LONG + " end", None])
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {r.doc_id: r for r in piece_bpe.encode_documents(docs, PIECES, digests=True).collect()}
    assert pieces[0].ids_sha256 == hashlib.sha256(",".join(map(str, sp.encode(LONG))).encode()).hexdigest()
    packed = packing.pack_documents(docs, WORD_BPE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    tokenizer = packing.load_tokenizer(WORD_BPE)
    assert {r.doc_id: r.n for r in packed}[0] == len(tokenizer.encode(LONG, add_special_tokens=False).ids) + 1
    removed = {r.doc_id: r.n_removed for r in substring.removal_digests(docs).collect()}
    assert removed == {0: 0, 1: 0, 2: 240_000, 3: 0}
    assert {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    model = langid.ByteGRU(["a", "b"], hidden=3, seed=3)
    found = {r.doc_id: r for r in langid.identify_languages(docs, model, marks=True).collect()}
    assert len(found[0]["labels"]) == len(LONG) and found[3].lang_pred == "und"
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    assert LONG in chat.render_conversations(turns).first().text


def test_training_windows_cover_the_whole_text():
    text = "".join(chr(97 + k % 26) for k in range(300))
    windows = langid.training_windows(text)
    assert [w.decode() for w in windows] == [text[:128], text[128:256], text[172:]]
    assert langid.training_windows("ab") == [b"ab".ljust(128)] and len(langid.training_windows("")) == 1


def test_classifiers_on_repeated_rows_and_empty_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    empty = docs.limit(0)
    assert langid.identify_languages(empty, langid.fit_language_model(empty)).count() == 0
    assert quality.score_quality(empty, quality.fit_quality_model(empty, labels)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity_model(empty, labels)).count() == 0
    twice = documents(spark, ["a good text", "a good text", None], [4, 4, None])
    model = langid.ByteGRU(["a", "b"], hidden=3, seed=3)
    for rows in (langid.identify_languages(twice, model), quality.score_quality(twice, None), toxicity.score_toxicity(twice, None)):
        got = rows.collect()
        assert collections.Counter(r.doc_id for r in got) == {4: 2, None: 1} and len({r.score for r in got if r.doc_id == 4}) == 1
    conflicting = labelled(spark, [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)])
    quality.fit_quality_model(twice, conflicting)
    toxicity.fit_toxicity_model(twice, conflicting)


# ---- near duplicates and passages


def test_every_text_of_a_repeated_doc_id_links(spark):
    a, b = words_of(120, 1, 3000), words_of(120, 2, 3000)
    near_b = list(b)
    near_b[60] = "changed"
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(near_b)), (3, " ".join(a)), (5, None), (9, "alone in here"), (8, None)]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows], extra=True)
    got = [(r.doc_id, r.class_id) for r in neardup.near_duplicate_classes(df).collect()]
    assert sorted(got) == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 3), (8, 8), (9, 9)]


def test_classes_with_hot_copies_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    monkeypatch.setattr(neardup, "HUB_BYTES", 2000)
    base, r = words_of(90, 5, 2000), random.Random(3)
    texts = [" ".join(base)] * 30
    for k in range(40):
        w = list(base)
        w[r.randrange(90)] = f"n{k}"
        texts.append(" ".join(w))
    texts += [" ".join(words_of(80, 100 + k, 5000)) for k in range(20)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = {x.doc_id: x.class_id for x in neardup.near_duplicate_classes(documents(spark, texts, ids)).collect()}
    assert got == classes_by_force(texts, ids)


def test_recall_of_near_copies(spark):
    """Of all pairs of sf0.01 from 0.8 on, by brute force over an index of shingles, the share in one class."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    hasher = neardup.RunHasher()
    sets = {r.doc_id: neardup.shingles(hasher, hasher.words([neardup.WORDS.findall(r.text)])[0]) for r in docs}
    having = collections.defaultdict(list)
    for i, (s, _) in sets.items():
        for x in s:
            having[x].append(i)
    shared = collections.Counter((i, j) for group in having.values() if len(group) > 1 for k, i in enumerate(group) for j in group[k + 1 :])
    links = [(i, j) for (i, j), n in shared.items() if n >= 0.5 * min(len(sets[i][0]), len(sets[j][0])) and neardup.probability_jaccard(sets[i], sets[j]) >= 0.8]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(links) > 20 and sum(got[i] == got[j] for i, j in links) / len(links) >= 0.99


def test_columns_of_passages_stay(spark):
    passage = " ".join(words_of(60, 1))
    texts = [passage, "lead " + passage, passage + "  ", "alone"]
    df = documents(spark, texts, [1, 2, 3, 4], extra=True).withColumns({c: F.lit("mine") for c in ("kept_", "doc", "key", "row", "new", "first", "least", "copy", "tkey", "n")})
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert [got[k].text for k in (1, 2, 3, 4)] == [passage, "lead", "", "alone"]
    assert all(r[c] == "mine" for r in got.values() for c in ("kept_", "doc", "key", "row", "new", "first", "least", "copy", "tkey", "n"))
    assert [got[k].n_chars for k in (2, 3)] == [4, 0]


def test_repeated_ids_and_hot_copies_of_passages(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    passage = words_of(70, 1)
    texts = [" ".join(passage)] * 20 + [" ".join(words_of(30, 50 + k) + passage) for k in range(10)] + ["  ".join(passage), None, ""]
    ids = [9] * 5 + list(range(20, 35)) + list(range(40, 50)) + [9, 60, 61]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digests(documents(spark, texts, ids)).collect())
    assert got == collections.Counter((i, *x) for i, x in zip(ids, removed_by_force(texts, ids, 50)))


# ---- neighbours


def test_stopping_test_stops_and_recall_holds():
    """Ten thousand vectors in clusters: nine in ten true neighbours are found though most vectors are never verified."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(200, 48)) * 2
    x = centres[r.integers(0, 200, 10_000)] + r.normal(size=(10_000, 48))
    ids = np.arange(len(x))
    space = ann.Space(np.abs(x).max(), 1.0, ann.DIMS, 17)
    space.norm = np.linalg.norm(x * space.scale, axis=1).max() * (1 + 1e-12)
    asked = np.arange(0, 10_000, 100)
    found = list(ann.search(space, ann.chi_square_quantile(ann.CONFIDENCE, ann.DIMS), 20, x, ids, space.points(x), x[asked], ids[asked], np.full(len(asked), -np.inf)))
    hit = verified = 0
    for q, (rows, n) in zip(asked, found):
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len(set(np.argsort(-scores)[:20]) & set(rows.tolist()))
        verified += n
    assert hit / (20 * len(asked)) >= 0.9 and verified / (len(asked) * len(x)) < 0.6


def test_routed_search_over_many_cells(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 12)) + 3 * r.integers(0, 2, (3000, 1))
    x[:900] = x[0]  # a third of all vectors are one
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    v = ann.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for f in ann.nearest_neighbours(v.where("vec_id % 60 = 0"), v, k=10, chunk=200, block=7, sample=500).orderBy("query_id", "rank").collect():
        got[f.query_id].append((f.vec_id, f.score))
    hit = 0
    for q in range(0, 3000, 60):
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        best = set(np.lexsort((np.arange(3000), -scores))[:10].tolist())
        hit += len(best & {i for i, _ in got[q]})
        assert len(got[q]) == 10 and all(s == scores[i] for i, s in got[q])
    assert hit / (50 * 10) >= 0.9


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 0.0]), (3, [1e-200, 0.0]), (4, [-1e200, 1.0]), (20, [2e200, 1.0])]
    v = ann.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.vec_id, r.score) for r in ann.nearest_neighbours(v.where("vec_id = 20"), v, k=4).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 2, 3, 4] and got[0][1] == float("inf") and got[2][1] == 2.0

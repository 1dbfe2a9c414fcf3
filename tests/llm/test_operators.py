"""The training-data operators against brute force, libraries and planted cases, on small tables with every awkward kind of row."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from accordwell.llm import ann, chat, graph, hashing, langid, neardup, packing, piece_bpe, quality, subwords, substring, topk, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PIECES, WORD_BPE = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [None, "", " ", "\n\n", "a", "  two  words ", "\t", "é́ ﬁ Σς İ", "😀😀 x", "a" * 3000, "<|endoftext|> <s>x</s>", "1234.5%", "\x00a", "aba" * 500, "\xa0nb sp"]


def documents(spark, texts, ids=None, extra=False):
    rows = [(i, t, "en" if i is None or i % 2 else "fr", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns that clash with names used inside
        for name in ("ids", "salt", "tkey", "bands", "node", "h", "score", "held_out", "label"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def words_of(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# ---- piece BPE


def test_piece_bpe_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(3)
    alphabet = "ab e\n▁  the<s>tionáß😀'\x00aaaa\t\xa0  éin"
    texts = [t for t in ODD if t is not None] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    codec = piece_bpe.Codec(PIECES)
    for text, (ids, decoded) in zip(texts, codec.encode_decode(texts)):
        want = sp.encode(text)
        assert ids == ",".join(map(str, want)), text
        assert decoded == sp.decode(want), text


def test_piece_bpe_rows(spark):
    df = documents(spark, ODD, extra=True)
    full = {r.doc_id: r for r in piece_bpe.encode_documents(df.union(df), PIECES).collect()}
    digests = piece_bpe.encode_documents(df.union(df), PIECES, digests=True).collect()
    assert len(digests) == 2 * len(ODD)
    for r in digests:
        assert r.ids_sha256 == hashlib.sha256(full[r.doc_id].ids.encode()).hexdigest()
        assert r.n_tokens == len([x for x in full[r.doc_id].ids.split(",") if x])
    assert full[0].n_tokens == 0 and full[0].decoded == ""
    assert piece_bpe.encode_documents(df.limit(0), PIECES).count() == 0


# ---- packing


def test_word_ids_equal_the_library():
    tokenizer = packing.load_tokenizer(WORD_BPE)
    r = random.Random(2)
    parts = [" ", "a", "B", "ſ", "İ", "Σ", "É", "é", "'s", "'T", "9", "१", "<|endoftext|>", "<|EndOfText|>", ".", "!", "\n", "\xa0", "́", "ß", "漢", "&&&", "😀", "z.", "Q,", "יִ", "\x0b", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for text, raw in zip(texts, packing.WordIds(WORD_BPE).encode(pa.array(texts))):
        assert raw == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_first_fit_decreasing_is_first_fit():
    r = random.Random(1)
    lengths = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    room, want = [], []
    for n in lengths:
        k = next((i for i, free in enumerate(room) if free >= n), None)
        if k is None:
            room.append(100)
            k = len(room) - 1
        room[k] -= n
        want.append(k)
    assert packing.first_fit_decreasing(lengths, 100) == want


def test_packing_keeps_every_id_once(spark):
    tokenizer = packing.load_tokenizer(WORD_BPE)
    texts = ODD + [" ".join(words_of(n, n)) for n in (10, 500, 3000, 7000)]
    df = documents(spark, texts, extra=True)
    pieces = packing.pack_documents(df.union(df.limit(3)), WORD_BPE, group_docs=5, keep_ids=True).toPandas()
    for doc, own in pieces.groupby("doc_id"):
        copies = 2 if doc < 3 else 1
        want = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        assert own["length"].sum() == copies * len(want)
        for r in own.itertuples():
            assert list(r.ids) == want[r.start : r.start + r.length] and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    assert packing.pack_documents(df.limit(0), WORD_BPE).count() == 0


# ---- exact top-k and neighbours


def vectors(spark, seed=5, n=120, dim=6):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dim).round(2).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(900, None), (901, [None] + [1.0] * (dim - 1)), (902, [float("nan")] + [1.0] * (dim - 1)), (903, [float("inf")] * dim), (904, [0.0] * dim), (905, [1.0, 2.0]), (None, [1.0] * dim)]
    rows += [rows[3], rows[4]]  # repeated rows
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit("clash"))


def test_top_k_equals_brute_force(spark):
    rows, df = vectors(spark)
    v = topk.integer_vectors(df)
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(v.where("vec_id % 10 = 0"), v, k=7, bins=16, chunk=40, block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.floor(1024 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    for q, x in {i: x for i, x in good if i % 10 == 0}.items():
        every = sorted(((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x)))[:7]
        assert got[q] == [(i, -s) for s, i in every]
    few = v.where("vec_id < 4")
    assert topk.exact_top_k(few.where("vec_id = 0"), few, k=10).count() == 4  # the repeated row counts
    assert topk.exact_top_k(v.limit(0), v.limit(0)).count() == 0


def test_neighbours_recall(spark):
    rows, df = vectors(spark, n=2000, dim=16)
    v = ann.clean_vectors(df)
    got = collections.defaultdict(list)
    for r in ann.nearest_neighbours(v.where("vec_id % 20 = 0"), v, k=10, chunk=500, block=30, sample=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    hit = total = 0
    for q, x in {i: x for i, x in good if i % 20 == 0}.items():
        every = sorted(((-float((x * y).sum()), i) for i, y in good if i != q and len(y) == len(x)))[:10]
        hit += len({i for _, i in every} & {i for i, _ in got[q]})
        total += len(every)
        assert len(got[q]) == len(every)
        assert all(abs(s - float((x * dict(good)[i]).sum())) < 1e-12 for i, s in got[q])
    assert hit / total >= 0.95
    assert ann.nearest_neighbours(v.limit(0), v.limit(0)).count() == 0


def test_chi_square_quantile():
    draws = (np.random.default_rng(1).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert abs((draws <= ann.chi_square_quantile(0.97, 8)).mean() - 0.97) < 0.002


# ---- passages


def removed_by_force(texts, ids, window):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for i, w in zip(ids, split):
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, split):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_passages_equal_brute_force(spark, monkeypatch, hot):
    if hot:  # every shard is dealt over several tasks
        monkeypatch.setattr(substring, "SHARD_WORDS", 300)
        monkeypatch.setattr(substring, "HOT_WORDS", 600)
    passage, other = words_of(80, 1), words_of(55, 2)
    texts, r = [], random.Random(4)
    for k in range(40):
        own = words_of(r.randint(0, 120), 100 + k)
        if k % 3 == 0:
            own = own[:30] + passage[r.randint(0, 10) :] + own[30:]
        if k % 4 == 0:
            own = own + other[: r.randint(45, 55)]
        texts.append(" ".join(own))
    texts += [texts[0]] * 5 + [" ".join(["same"] * 130), " ".join(["same"] * 70), "x y " * 60, "x y " * 60] + ODD
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids[3], ids[-1] = ids[0], None
    df = documents(spark, texts, ids, extra=True)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digests(df).collect())
    assert got == collections.Counter((i, *x) for i, x in zip(ids, removed_by_force(texts, ids, 50)))
    kept = substring.remove_repeats(df)
    assert kept.columns == df.columns and kept.count() == len(texts)
    assert substring.removal_digests(df.limit(0)).count() == 0


# ---- near duplicates


def jaccard(a, b):
    x, y = (collections.Counter(tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))) for w in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in x if d in y)


def classes_by_force(texts, ids):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(ids, texts)]
    root = {i: i for i, _ in split}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(split, 2):
        if a and b and jaccard(a, b) >= 0.8:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_classes_equal_brute_force(spark):
    r = random.Random(8)
    texts = []
    for k in range(12):
        base = words_of(r.randint(60, 160), 200 + k)
        for j in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(j % 4):
                w[r.randrange(len(w))] = f"n{r.random()}"
            texts.append(" ".join(w))
    chain = words_of(200, 300)  # each near the next, the ends far from one another
    texts += [" ".join(chain[k * 12 : k * 12 + 140]) for k in range(5)]
    texts += ["one two", "one two", "one  two", "three", *ODD]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    df = documents(spark, texts, ids, extra=True)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(df).collect()}
    assert got == classes_by_force(texts, ids)
    assert neardup.keep_one_of_each(df).count() == len(set(got.values()))
    assert neardup.near_duplicate_classes(df.limit(0)).count() == 0
    some = documents(spark, ["a b c d e f", "a b c d e f", None], [None, 3, None])
    assert sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicate_classes(some).collect()), key=str) == [(3, 3), (None, None), (None, None)]


def test_cross_links_join_what_hubs_miss():
    chain = words_of(200, 300)
    texts = [" ".join(chain[k * 12 : k * 12 + 140]) for k in range(5)]
    hasher = hashing.RunHasher()
    sets = [neardup.shingles(hasher, h) for h in hasher.words([t.split() for t in texts])]
    doc = np.repeat(np.arange(5), [len(s) for s, _ in sets])
    ids = neardup.prob_min_hash(np.concatenate([s for s, _ in sets]), np.concatenate([c for _, c in sets]).astype(float), doc, 5, 120)
    table = pa.table(
        {"bucket": [1] * 5, "node": range(5), "label": range(5), "block": [0] * 5, "i": [0] * 5, "j": [0] * 5, "digest": [(x >> np.uint64(48)).astype(np.uint16).tobytes() for x in ids], "bands": [[1]] * 5, "text": texts}
    )
    want = {(i, j) for i, j in itertools.combinations(range(5), 2) if jaccard(texts[i].split(), texts[j].split()) >= 0.8}
    got = neardup._cross_links(0.8, 120)(table).to_pydict()
    root = {i: min([i, *(a for a, b in want if b == i)]) for i in range(5)}
    assert len(got["a"]) == 4 - sum(1 for i in range(1, 5) if root[i] == i) and {(min(p), max(p)) for p in zip(got["a"], got["b"])} <= want


def test_signatures_estimate_the_similarity():
    r = np.random.default_rng(2)
    a = (np.arange(400, dtype=np.uint64) * np.uint64(977), r.integers(1, 5, 400))
    b = (a[0][60:], np.maximum(1, a[1][60:] + r.integers(-1, 2, 340)))
    doc = np.repeat([0, 1], [400, 340])
    ids = neardup.prob_min_hash(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]).astype(float), doc, 2, 20_000)
    assert abs((ids[0] == ids[1]).mean() - neardup.probability_jaccard(a, b)) < 0.015


def test_bounds_are_never_below_the_similarity(monkeypatch):
    monkeypatch.setattr(neardup.Overlaps, "PORTION", 50)
    r, unit = np.random.default_rng(4), np.ones(40, np.int64)
    sets = [(np.unique(r.integers(0, 40, 30).astype(np.uint64)), None) for _ in range(30)]
    sets = [(s, r.integers(1, 4, len(s)) if k % 2 else unit[: len(s)]) for k, (s, _) in enumerate(sets)]
    overlaps = neardup.Overlaps(sets)
    for k in range(30):
        others = np.delete(np.arange(30), k)
        exact = np.array([neardup.probability_jaccard(sets[k], sets[o]) for o in others])
        bounds = overlaps.bounds(k, others)
        assert (bounds >= exact - 1e-12).all()
        if k % 2 == 0:  # without repeats on either side the bound is the similarity
            assert np.allclose(bounds[others % 2 == 0], exact[others % 2 == 0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (101, 100), (200, 300)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- classifiers


def numeric_gradient(model, seq, truth, name, at, eps=1e-2):
    def loss():
        p, h = model.params, model.hidden
        outs = []
        for d in "01":
            state = np.zeros((h, seq.shape[1]))
            out = np.empty((len(seq), h, seq.shape[1]))
            for t in range(len(seq)) if d == "0" else range(len(seq) - 1, -1, -1):
                a, u = p["x" + d][:, seq[t]].astype(float), p["u" + d].astype(float) @ state
                z, r = (1 / (1 + np.exp(-(a[k * h : k * h + h] + u[k * h : k * h + h]))) for k in (0, 1))
                state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :])
                out[t] = state
            outs.append(out)
        logits = p["w0"] @ outs[0] + p["w1"] @ outs[1] + p["b"]
        q = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        return -np.log(q[:, truth, np.arange(len(truth))]).mean()

    keep = model.params[name][at]
    model.params[name][at] = keep + eps
    up = loss()
    model.params[name][at] = keep - eps
    down = loss()
    model.params[name][at] = keep
    return (up - down) / (2 * eps)


def test_backpropagation_through_time():
    model = langid.ByteGRU(["a", "b", "c"], hidden=3, seed=1)
    seq, truth = np.random.default_rng(0).integers(0, 256, (7, 5)), np.array([0, 1, 2, 1, 0])
    grads = model._gradients(seq, truth)
    for name in ("x0", "x1", "u0", "u1", "w0", "w1", "b"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        assert abs(grads[name][at] - numeric_gradient(model, seq, truth, name, at)) < 2e-3


SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_language_model(docs, steps=150)
    got = langid.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9
    odd = documents(spark, ODD + ["12 34"], extra=True)
    rows = {r.doc_id: r for r in langid.identify_languages(odd, model, marks=True).collect()}
    for i, t in enumerate(ODD + ["12 34"]):
        letters = any(map(str.isalpha, t or ""))
        assert (rows[i].lang_pred == "und") == (not letters) and len(rows[i]["labels"]) == len((t or "").encode()) and 0 <= rows[i].score <= 1
    assert langid.keep_identified(odd, model, 0.0).columns == odd.columns
    assert langid.identify_languages(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(odd, langid.fit_language_model(odd.limit(0))).collect()} == {"und"}


def test_window_labels_equal_a_plain_run():
    model = langid.ByteGRU(["a", "b"], hidden=4, seed=3)
    text = ("plain text " * 60).encode()
    names, score, labels = langid.Pooler(model).pool(pa.array([text.decode(), None]), marks=True)
    total = np.zeros(2)
    for k in range(0, len(text), langid.WINDOW):
        part = np.frombuffer(text[k : k + langid.WINDOW].ljust(langid.WINDOW), np.uint8)
        h, p, outs = 4, model.params, []
        for d in "01":
            state, out = np.zeros(h), np.zeros((langid.WINDOW, h))
            for t in range(langid.WINDOW) if d == "0" else range(langid.WINDOW - 1, -1, -1):
                a, u = p["x" + d][:, part[t]], p["u" + d] @ state
                z, r = (1 / (1 + np.exp(-(a[j * h : j * h + h] + u[j * h : j * h + h]))) for j in (0, 1))
                state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :])
                out[t] = state
            outs.append(out)
        logits = outs[0] @ p["w0"].T + outs[1] @ p["w1"].T + p["b"].ravel()
        q = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        total += q[: len(text[k : k + langid.WINDOW])].sum(axis=0)
    assert abs(score[0] - total.max() / len(text)) < 1e-4 and names[1] == "und" and len(labels[0]) == len(text)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality_model(docs, labels)
    got = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    odd = quality.score_quality(documents(spark, ODD, extra=True), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.fit_quality_model(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(documents(spark, ODD), None).collect()} == {0.5}


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity_model(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9
    assert got[(got.toxic == 0)].predicted.mean() < 0.05
    odd = documents(spark, ODD, extra=True)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.fit_toxicity_model(docs, labels.limit(0)) is None
    assert toxicity.score_toxicity(odd, None).agg(F.max("score")).first()[0] == 0


def test_subword_features_know_their_words():
    flat, counts = subwords.subword_features(["ab", "xyz", "ab"], 16, 3, 4)
    own = np.split(flat, np.cumsum(counts)[:-1])
    assert (own[0] == own[2]).all() and counts.tolist() == [2 + 1 + 1, 3 + 2 + 1, 4]
    assert subwords.subword_features([], 16, 3, 4)[0].size == 0


# ---- chat


def test_repair_is_cheapest():
    r = random.Random(1)
    for _ in range(300):
        roles = tuple(r.randrange(4) for _ in range(r.randint(1, 5)))
        best = 10**9
        for given in itertools.product((1, 2, 3), repeat=len(roles)):
            cost, at = 0, 0
            for role, o in zip(roles, given):
                cost, at = cost + chat.WAYS[at][o][0] + chat.RELABEL * (role != o), o
            best = min(best, cost + chat.INSERT * len(chat.ENDINGS[at]))
        path = chat.repair(roles)
        assert best == sum(chat.WAYS[a][b][0] + chat.RELABEL * (b != x) for x, (a, b) in zip(roles, path)) + chat.INSERT * len(chat.ENDINGS[path[-1][1]])


def test_conversations_do_not_depend_on_partitions(spark):
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(20)]), r.choice(["user", "assistant", "system", "tool", None, "User"]), r.choice(["a", "b", None, ""])) for _ in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    one = {r.conv_id: (r.cost, r.text) for r in chat.render_conversations(df).collect()}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "25")
        many = chat.format_conversations(df)
        assert {r.conv_id: (r.cost, r.text) for r in chat.render_conversations(df).collect()} == one
        assert many.count() == len(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for _, text in one.values():
        roles = re.findall(r"<\|(system|user|assistant)\|>", text)
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2)
    assert chat.format_conversations(df.limit(0)).count() == 0

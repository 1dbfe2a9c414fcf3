"""Removal of long passages that an earlier document has, located by Aho-Corasick automata.

1. Every text gives anchors: of each window of words, the run of ``PHRASE`` words with the least hash.
   Equal windows have equal anchors. Anchors that occur in several documents mark recurring
   passages; the smallest document that has an anchor owns it.
2. Recurring anchors, and the texts that have them, go to the shard of the owner. There the
   anchors' phrases are compiled into automata over words, and the texts are streamed through
   to locate every occurrence. All texts that share a window meet in a shard. Documents with equal word sequences
   share one text, which is streamed once: of the windows located in it, those that begin earlier elsewhere go from the smallest of these documents, all go from the others.
3. Around the occurrences windows are compared as a whole, by 128-bit hashes, for the
   smallest document that has them.

A shard with too many words is dealt over several tasks (its automata are copied); the windows of such
shards are compared across tasks by an aggregation instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_some_hot, materialise, portions
from .hashing import WORDS, RunHasher, window_minima

WINDOW, PHRASE = 50, 12
SHARD_WORDS, HOT_WORDS = 300_000, 2_400_000
AUTOMATON = 80_000  # phrases of one automaton at most: their words fit Unicode's code space
FACTS = "doc_id long, tkey long, n_words long, t1 long, t2 long, full_sha256 string, anchors array<long>"
LOCATED = "doc_id long, tkey long, text string, every array<int>, starts array<int>, h1 array<long>, h2 array<long>"


def _facts(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher()
        for batch in batches:
            for part in portions(batch, 2):
                texts = [WORDS.findall(t or "") for t in part.column(2).to_pylist()]
                out: dict[str, list] = {"n_words": [], "t1": [], "t2": [], "full_sha256": [], "anchors": []}
                for words, hashes in zip(texts, hasher.words(texts)):
                    joined = " ".join(words).encode("utf-8", "surrogatepass")
                    whole = np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64)
                    least = window_minima(hasher.runs(hashes, phrase), window - phrase + 1)
                    for name, value in zip(out, (len(words), whole[0], whole[1], hashlib.sha256(joined).hexdigest(), np.unique(least).view(np.int64))):
                        out[name].append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
                arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["doc_id", "tkey", *out])

    return run


def find_phrases(phrases: list[tuple], texts: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Where phrases (k word hashes each) begin in each text, by Aho-Corasick automata over words."""
    import ahocorasick

    found: list[list] = [[] for _ in texts]
    for at in range(0, len(phrases), AUTOMATON):
        some = np.array(phrases[at : at + AUTOMATON], np.uint64)
        alphabet = np.unique(some)
        letters = lambda a: (np.searchsorted(alphabet, a) + 1).astype("<u4")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for row in letters(some):
            automaton.add_word(row.tobytes().decode("utf-32-le", "surrogatepass"), 1)
        automaton.make_automaton()
        for i, text in enumerate(texts):
            code = letters(text)
            code[alphabet[np.minimum(code - 1, len(alphabet) - 1)] != text] = 0
            found[i].extend(end - k + 1 for end, _ in automaton.iter(code.tobytes().decode("utf-32-le", "surrogatepass")))
    return [np.unique(np.array(x, np.int64)) for x in found]


def _locate(window: int, phrase: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({n.split()[0]: pa.array([], t) for n, t in zip(LOCATED.split(", "), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())))})
        if not left.num_rows or not right.num_rows:
            return empty
        hasher = RunHasher()
        texts = left.column("text").to_pylist()
        hashes: list[np.ndarray] = []
        for k in range(0, len(texts), 500):
            hashes += hasher.words([WORDS.findall(t or "") for t in texts[k : k + 500]])
        wanted = np.unique(right.column("anchor").to_numpy().view(np.uint64))
        # the phrases behind the anchors, each read where it occurs first
        phrases: dict[int, tuple] = {}
        for own in hashes:
            runs = hasher.runs(own, phrase)
            for p in np.flatnonzero(np.isin(runs, wanted)):
                if (key := int(runs[p])) not in phrases:
                    phrases[key] = tuple(own[p : p + phrase].tolist())
        places = find_phrases(list(phrases.values()), hashes, phrase)
        starts, h1, h2 = [], [], []
        for own, at in zip(hashes, places):
            last = len(own) - window
            edge = np.zeros(max(0, last) + 2, np.int64)
            if last >= 0 and len(at):
                np.add.at(edge, np.clip(at + phrase - window, 0, last + 1), 1)
                np.add.at(edge, np.clip(at, -1, last) + 1, -1)
            near = np.flatnonzero(np.cumsum(edge) > 0)
            starts.append(near)
            h1.append(hasher.runs(own, window)[near] if len(near) else np.empty(0, np.uint64))
            h2.append(hasher.runs(own, window, 1)[near] if len(near) else np.empty(0, np.uint64))
        copied, every = left.column("copied").to_pylist(), starts
        doc_ids, hot = left.column("doc_id").to_numpy(), left.column("hot")[0].as_py()
        if not hot:  # every document with these windows is here
            doc = np.repeat(doc_ids, [len(s) for s in starts])
            a, b = np.concatenate(h1), np.concatenate(h2)
            order = np.lexsort((doc, b, a))
            new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(order) else np.empty(0, bool)
            least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            late = np.zeros(len(order), bool)
            late[order] = doc[order] > least
            cut = np.cumsum([0, *(len(s) for s in starts)])
            starts = [s[late[i:j]] for s, i, j in zip(starts, cut, cut[1:])]
        rows = [i for i, s in enumerate(starts) if len(s) or copied[i] and len(every[i])]
        if not rows:
            return empty
        take = left.take(pa.array(rows))
        lists = lambda arrays, kind: pa.array([arrays[i].astype(kind) if kind is np.int32 else arrays[i].view(np.int64) for i in rows], pa.list_(pa.int32() if kind is np.int32 else pa.int64()))
        none = pa.nulls(len(rows), pa.list_(pa.int64()))
        return pa.table(
            {
                "doc_id": take.column("doc_id"),
                "tkey": take.column("tkey"),
                "text": take.column("text"),
                "every": pa.array([every[i].astype(np.int32) if copied[i] else None for i in rows], pa.list_(pa.int32())),
                "starts": lists(starts, np.int32),
                "h1": lists(h1, np.int64) if hot else none,
                "h2": lists(h2, np.int64) if hot else none,
            }
        )

    return run


def _cut(text: str | None, starts: pa.Scalar, window: int) -> tuple[int, str]:
    """(how many words lie in windows that begin at ``starts``, the other words)."""
    words = WORDS.findall(text or "")
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.unique(starts.values.to_numpy(zero_copy_only=False))
    edge[at] += 1
    edge[at + window] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), " ".join([w for w, g in zip(words, gone.tolist()) if not g])


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2):
                own = [_cut(t, s, window) for t, s in zip(part.column(2).to_pylist(), part.column(3))]
                copies = [_cut(t, s, window) for t, s in zip(part.column(2).to_pylist(), part.column(4))]
                columns = [pa.array([x[k] for x in some], t) for some in (own, copies) for k, t in ((0, pa.int64()), (1, pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "tkey", "removed", "kept", "copy_removed", "copy_kept"])

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """(facts, changes) about the texts of ``docs``: doc_id, text, and tkey, a hash of the text.

    ``facts``, a row for each row of ``docs``: doc_id, tkey, n_words, t1, t2 (the word sequence), full_sha256 (of all words joined by a
    space). ``changes``, a row for each word sequence in which something goes: t1, t2, n (documents that have it), first (the smallest of them), tkey (of
    its text), removed and kept (number of words, and the text, in the first document), copy_removed and copy_kept (the same in the others).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tkey", F.col("text").cast("string").alias("text"))
    facts = materialise(rows.mapInArrow(_facts(window, phrase), FACTS))
    heads = materialise(
        facts.where("doc_id is not null")
        .groupBy("t1", "t2")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.max("doc_id").alias("last"),
            F.count("*").alias("n"),
            F.min_by("tkey", "doc_id").alias("tkey"),
            F.any_value("n_words").alias("n_words"),
            F.any_value("anchors").alias("anchors"),
        )
    )
    copied = (F.col("doc_id") < F.col("last")).alias("copied")
    anchors = heads.select("doc_id", "last", "tkey", "n_words", copied, F.explode("anchors").alias("anchor"))
    owned = materialise(
        anchors.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("last").alias("last")).where("owner < last").select("anchor", "owner")
    )
    routes = materialise(anchors.join(owned, "anchor").select("doc_id", "tkey", "n_words", "copied", "owner").distinct())
    shards = max(1, -(-(routes.agg(F.sum("n_words")).first()[0] or 0) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard")
    routes = routes.select("doc_id", "tkey", "n_words", "copied", shard).distinct()
    sizes = routes.groupBy("shard").agg(F.sum("n_words").alias("words")).select(
        "shard",
        F.when(F.col("words") > HOT_WORDS, F.ceil(F.col("words") / SHARD_WORDS)).otherwise(1).cast("int").alias("salts"),
    )
    # each text once, however often its row is repeated
    texts = rows.hint("merge").join(routes.select("doc_id", "tkey").distinct(), ["doc_id", "tkey"]).groupBy("doc_id", "tkey").agg(F.min("text").alias("text"))
    dealt = (
        routes.join(sizes, "shard")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "tkey"), F.col("salts")).cast("int"))
        .withColumn("hot", F.col("salts") > 1)
        .join(texts.hint("merge"), ["doc_id", "tkey"])
        .select("shard", "salt", "doc_id", "tkey", "hot", "copied", "text")
    )
    phrases = owned.select("anchor", shard.alias("shard")).join(sizes, "shard").select(
        F.col("shard").alias("shard_"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt_"), "anchor"
    )
    located = materialise(
        dealt.groupBy("shard", "salt").cogroup(phrases.groupBy("shard_", "salt_")).applyInArrow(_locate(window, phrase), LOCATED)
    )
    pending = located.where("h1 is not null").select("doc_id", "tkey", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select(
        "doc_id", "tkey", "w.starts", "w.h1", "w.h2"
    )
    earliest = pending.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    pending = join_some_hot(pending, materialise(earliest.select("h1", "h2", "first", "n")), ["h1", "h2"], pending.count())
    late = pending.where("doc_id > first").select("doc_id", "tkey", F.array("starts").alias("starts"))
    none = F.array().cast("array<int>")
    covered = (
        located.select("doc_id", "tkey", F.when(F.col("h1").isNull(), F.col("starts")).otherwise(none).alias("starts"), F.coalesce("every", none).alias("every"))
        .unionByName(late.withColumn("every", none))
        .groupBy("doc_id", "tkey")
        .agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "every")))
    )
    texts = located.groupBy("doc_id", "tkey").agg(F.first("text").alias("text"))
    changes = texts.join(covered, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "starts", "every").mapInArrow(
        _keep(window), "doc_id long, tkey long, removed long, kept string, copy_removed long, copy_kept string"
    )
    changes = changes.join(heads.select("doc_id", "tkey", "t1", "t2", "n"), ["doc_id", "tkey"]).withColumnRenamed("doc_id", "first")
    return facts.drop("anchors"), materialise(changes)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def removal_digests(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of ``docs`` (doc_id, text; other columns are ignored).

    A word goes if a window of ``window`` words around it also starts in a document with a smaller doc_id, judged on the input.
    Null texts have no words. Rows that repeat a doc_id don't count as smaller than one another; a null
    doc_id is neither smaller nor larger than any, so nothing of it goes. An empty table gives an empty result.
    """
    facts, changes = repeated_passages(docs.select("doc_id", "text", _text_key(F.col("text")).alias("tkey")), window, phrase)
    sums = changes.select("t1", "t2", "n", "first", "removed", "copy_removed", *(F.sha2(F.col(c), 256).alias(c) for c in ("kept", "copy_kept")))
    copy, own = F.col("doc_id") > F.col("first"), F.col("doc_id") == F.col("first")
    return join_some_hot(facts, sums, ["t1", "t2"], facts.count()).select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("copy_removed")).when(own, F.col("removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.col("copy_kept")).when(own, F.col("kept")).otherwise(F.col("full_sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with the words gone that ``removal_digests`` counts; texts that lose nothing stay as they are.

    All other columns are kept, whatever their names; n_chars (if there) follows the text.
    """
    columns = docs.columns
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), _text_key(F.col("text")).alias("key"), F.struct(*columns).alias("row"))
    facts, changes = repeated_passages(docs.select("doc_id", "text", _text_key(F.col("text")).alias("tkey")), window, phrase)
    own = changes.where("removed > 0").select(F.col("first").alias("doc"), F.col("tkey").alias("key"), F.col("kept").alias("new"))
    # texts of a doc_id that differ in spaces only lose the same words
    others = join_some_hot(facts.select("doc_id", "tkey", "t1", "t2"), changes.select("t1", "t2", "n", "first", F.col("tkey").alias("least"), "removed", "copy_removed"), ["t1", "t2"], facts.count())
    loses = others.where("(doc_id > first and copy_removed > 0) or (doc_id = first and tkey <> least and removed > 0)")
    some = loses.select("doc_id", "tkey", "first", "least", (F.col("doc_id") > F.col("first")).alias("copy")).distinct()
    kept = changes.select("first", F.col("tkey").alias("least"), "kept", "copy_kept")
    rest = some.join(kept, ["first", "least"]).select(F.col("doc_id").alias("doc"), F.col("tkey").alias("key"), F.when(F.col("copy"), F.col("copy_kept")).otherwise(F.col("kept")).alias("new"))
    out = keyed.join(own.unionAll(rest), ["doc", "key"], "left")
    text = F.coalesce("new", F.col("row.text"))
    values = {"text": text}
    if "n_chars" in columns:
        values["n_chars"] = F.when(F.col("new").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast("long"))
    return out.select(*(values.get(c, F.col("row").getField(c)).alias(c) for c in columns))

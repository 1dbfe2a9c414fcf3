"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the weighted set of its five-word shingles, weighted by how often they occur. Each
shingle is a Poisson process of that rate, whose arrivals fall into random slots of the signature; a slot keeps
the shingle that arrived first, and processes stop once they are later than every slot's first
arrival. Two texts agree in a slot with the probability that is their probability Jaccard similarity.

Equal word sequences are one node. Nodes that agree in a band of slots are candidates. The smallest node of a bucket is
compared exactly with the others there, and what is similar enough is linked; buckets whose
nodes are then still in several components are compared block by block: on their signatures, and where those may
reach the threshold and the two aren't connected yet, exactly. So a link is lost only where a pair shares no band (at 0.8, one in 10,000), and groups of copies
cost a comparison for each text, not for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_some_hot, materialise, portions
from .graph import components
from .hashing import WORDS, RunHasher

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5  # a pair at 0.8 shares a band with probability 0.9999
BLOCK = 1024
HUB_BYTES = 1 << 19  # texts of a hub's members in one task
SIGNED = "doc_id long, tkey long, t1 long, t2 long, bands array<long>, digest binary"
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(hasher: RunHasher, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, how often each occurs); a text with fewer words is one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(hasher.runs(hashes, min(size, len(hashes))), return_counts=True)


def _random(elements: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = elements + np.uint64(turn) * _STEP
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        return z ^ (z >> np.uint64(31))


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures (docs by slots) of the weighted sets whose members lie flat, ``doc`` saying whose each is."""
    first = np.full(docs * slots, np.inf)
    ids = np.zeros(docs * slots, np.uint64)
    time = np.zeros(len(elements))
    turn = 0
    while len(elements):
        turn += 1
        r = _random(elements, turn)
        time = time - np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / weights
        cell = doc * slots + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        ids[cell[won]] = elements[won]
        # nobody later than a document's last slot can change its signature any more
        go = time < first.reshape(docs, slots).max(axis=1)[doc]
        elements, weights, doc, time = elements[go], weights[go], doc[go], time[go]
    return ids.reshape(docs, slots)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles d of 1 / sum over all e of max(x[e] / x[d], y[e] / y[d])."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    ratio = np.divide(x, y, out=np.full(len(every), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    more = np.append(np.cumsum(x[::-1])[::-1], 0)[upto]  # where x[e] / y[e] > x[d] / y[d]
    rest = np.append(0, np.cumsum(y))[upto]
    common = (x > 0) & (y > 0)
    return float(np.sum(1 / (more[common] / x[common] + rest[common] / y[common])))


class Overlaps:
    """Upper bounds of a weighted set's probability Jaccard with many others, for whole arrays at once.

    The sum that a common shingle d is divided by is at least x / x[d] plus what only y has / y[d], and the same with
    both exchanged; without repeated shingles that is the sum itself.
    """

    PORTION = 1_000_000

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.cut = np.cumsum([0, *(len(s) for s, _ in sets)])
        every, self.code = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
        self.weight = np.concatenate([c for _, c in sets]).astype(np.float64)
        self.mass = np.add.reduceat(self.weight, self.cut[:-1])
        self.own = np.zeros(len(every))

    def bounds(self, r: int, others: np.ndarray) -> np.ndarray:
        mine = slice(self.cut[r], self.cut[r + 1])
        self.own[self.code[mine]] = self.weight[mine]
        portion = np.cumsum(self.cut[others + 1] - self.cut[others]) // self.PORTION
        out = [self._bounds(r, some) for some in np.split(others, np.flatnonzero(np.diff(portion)) + 1)]
        self.own[self.code[mine]] = 0
        return np.concatenate(out)

    def _bounds(self, r: int, others: np.ndarray) -> np.ndarray:
        n = self.cut[others + 1] - self.cut[others]
        whose = np.repeat(np.arange(len(others)), n)
        at = np.repeat(self.cut[others] - np.cumsum(n) + n, n) + np.arange(n.sum())
        x, y = self.own[self.code[at]], self.weight[at]
        only_x = self.mass[r] - np.bincount(whose, weights=x, minlength=len(others))
        common = x > 0
        whose, x, y = whose[common], x[common], y[common]
        only_y = self.mass[others] - np.bincount(whose, weights=y, minlength=len(others))
        least = np.maximum(self.mass[r] / x + only_y[whose] / y, self.mass[others][whose] / y + only_x[whose] / x)
        return np.bincount(whose, weights=1 / least, minlength=len(others))


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, slots = RunHasher(), bands * rows
        for batch in batches:
            for part in portions(batch, 1):
                texts = [WORDS.findall(t or "") for t in part.column(1).to_pylist()]
                whole = np.array([np.frombuffer(xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")), np.int64) for w in texts]).reshape(-1, 2)
                sets = [shingles(hasher, h) for h in hasher.words(texts)]
                sizes = np.array([len(s) for s, _ in sets])
                doc = np.repeat(np.arange(len(sets)), sizes)
                ids = prob_min_hash(np.concatenate([s for s, _ in sets]), np.concatenate([c for _, c in sets]).astype(np.float64), doc, len(sets), slots)
                with np.errstate(over="ignore"):
                    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP, len(sets), axis=0)
                    for j in range(rows):
                        keys = (keys ^ ids[:, j::rows]) * _MIX1
                        keys ^= keys >> np.uint64(31)
                digest = (ids >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(whole[:, 0], pa.int64()),
                        pa.array(whole[:, 1], pa.int64()),
                        pa.array([keys[i].view(np.int64) if n else [] for i, n in enumerate(sizes)], pa.list_(pa.int64())),
                        pa.array([digest[i].tobytes() if n else b"" for i, n in enumerate(sizes)], pa.binary()),
                    ],
                    names=["doc_id", "tkey", "t1", "t2", "bands", "digest"],
                )

    return run


def _similar(threshold: float):
    """Rows of one hub after another, the hub's own text first: those similar enough to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, hub = RunHasher(), None
        for batch in batches:
            member, keep = batch.column("member").to_pylist(), np.zeros(batch.num_rows, bool)
            for i, text in enumerate(batch.column("text")):
                own = shingles(hasher, hasher.words([WORDS.findall(text.as_py() or "")])[0])
                if member[i]:
                    keep[i] = probability_jaccard(own, hub) >= threshold
                else:
                    hub = own
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _cross_links(threshold: float, slots: int):
    # six standard errors below the threshold: a pair at the threshold is lost here with a probability of 1e-9
    least = int(slots * (threshold - 6 * (threshold * (1 - threshold) / slots) ** 0.5))

    def run(group: pa.Table) -> pa.Table:
        digest = np.frombuffer(b"".join(group.column("digest").to_pylist()), np.uint16).reshape(group.num_rows, -1)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        label, node, block = (group.column(c).to_numpy() for c in ("label", "node", "block"))
        bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        texts, hasher = group.column("text"), RunHasher()
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        asked: list[tuple[int, np.ndarray]] = []
        right = np.flatnonzero(block == j)
        for r in np.flatnonzero(block == i):
            others = right[(label[right] != label[r]) & ((node[right] > node[r]) | (i != j))]
            agree = (digest[others] == digest[r]).sum(axis=1)
            others, agree = others[agree >= least], agree[agree >= least]
            # each pair in the first of the bands that it shares
            first = (bands[others] == bands[r]).argmax(axis=1)
            mine = bands[r][first] == bucket
            if mine.any():
                asked.append((int(r), others[mine][np.argsort(-agree[mine], kind="stable")]))
        links: list[tuple[int, int]] = []
        if asked:
            rows = np.unique(np.concatenate([o for _, o in asked] + [[r] for r, _ in asked]))
            sets = [shingles(hasher, hasher.words([WORDS.findall(texts[int(r)].as_py() or "")])[0]) for r in rows]
            overlaps = Overlaps(sets)
        for r, others in asked:
            others = others[[find(x) != find(int(label[r])) for x in label[others].tolist()]]
            if not len(others):
                continue
            here, there = int(np.searchsorted(rows, r)), np.searchsorted(rows, others)
            may = overlaps.bounds(here, there) >= threshold - 1e-9
            for o, k in zip(others[may].tolist(), there[may].tolist()):
                x, y = find(int(label[r])), find(int(label[o]))
                if x != y and probability_jaccard(sets[here], sets[k]) >= threshold:
                    root[x] = y
                    links.append((int(label[r]), int(label[o])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id), a row for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked from a probability Jaccard similarity of ``threshold`` on; classes are the components, named by their smallest doc_id.
    Texts with the same words are equal; null texts and texts without words link nothing. Rows that repeat a
    doc_id are one document, which has all their texts. A null doc_id takes no part: its class is null. An empty table gives an empty result.
    All shingles of a very long text count; elements arrive until none can change a band, so memory is in proportion to the text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))
    signed = materialise(texts.mapInArrow(_sign(bands, rows), SIGNED))
    named = signed.where(F.col("doc_id").isNotNull() & (F.size("bands") > 0))
    # a text belongs to the smallest document that has it, its node; node and tkey name the text
    heads = materialise(
        named.groupBy("t1", "t2").agg(
            F.min("doc_id").alias("node"),
            F.count("*").alias("n"),
            F.min_by("tkey", "doc_id").alias("tkey"),
            F.any_value("bands").alias("bands"),
            F.any_value("digest").alias("digest"),
        )
    )
    placed = heads.select("node", "tkey", F.explode("bands").alias("bucket"))
    hubs = placed.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.min_by("tkey", "node").alias("hkey"), F.count("*").alias("n"))
    stars = join_some_hot(placed, materialise(hubs.where("hub < last").drop("last")), ["bucket"], heads.count() * bands).where("hub is not null")
    edges = materialise(stars.where("node <> hub").select(F.col("node").alias("a"), F.col("tkey").alias("ak"), F.col("hub").alias("b"), F.col("hkey").alias("bk")).distinct())
    involved = edges.select(F.col("a").alias("doc_id"), F.col("ak").alias("tkey")).unionAll(edges.select("b", "bk")).distinct()
    known = materialise(
        texts.hint("merge").join(involved, ["doc_id", "tkey"]).groupBy("doc_id", "tkey").agg(F.min("text").alias("text")).withColumn("bytes", F.octet_length("text"))
    )
    links = materialise(_verified(edges, known, threshold).unionAll(_same_document(named, heads)))
    labels = materialise(components(links))

    label = F.coalesce("label", F.col("node")).alias("label")
    members = materialise(stars.select("bucket", "node", "tkey").join(labels, "node", "left").select("bucket", "node", "tkey", label))
    open_buckets = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    rest = join_some_hot(members, materialise(open_buckets.select("bucket", blocks, "n")), ["bucket"], members.count()).where("blocks is not null")
    dealt = (
        rest.withColumn("block", F.pmod(F.xxhash64("node", "tkey"), F.col("blocks")).cast("int"))
        .join(heads.select("node", "tkey", "digest", "bands"), ["node", "tkey"])
        .join(known.select(F.col("doc_id").alias("node"), "tkey", "text"), ["node", "tkey"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "node", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "bands", "text")
    )
    more = materialise(dealt.groupBy("bucket", "i", "j").applyInArrow(_cross_links(threshold, bands * rows), "a long, b long").distinct())
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(more))
    named_classes = materialise(heads.join(labels, "node", "left").select("t1", "t2", label.alias("class_id"), "n"))
    ids = join_some_hot(signed.select("doc_id", "t1", "t2", (F.size("bands") > 0).alias("words")), named_classes, ["t1", "t2"], signed.count())
    wordless = signed.where(F.size("bands") == 0).select("doc_id")
    elsewhere = ids.where("words").join(wordless.distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return (
        ids.where("words")
        .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
        .unionAll(wordless.join(elsewhere, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id")))
    )


def _verified(edges: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``edges`` that are similar enough. A hub's members are dealt over tasks by their bytes; its text goes to each of these once."""
    left, right = (known.select(F.col("doc_id").alias(x), F.col("tkey").alias(x + "k"), "text", "bytes") for x in "ab")
    sizes = edges.join(left.drop("text"), ["a", "ak"]).groupBy("b", "bk").agg(F.count("*").alias("n"), F.ceil(F.sum("bytes") / HUB_BYTES).cast("int").alias("parts"))
    sizes = materialise(sizes)
    rows = ("a", "b", "bk", "part", "member", "text")
    part = F.pmod(F.xxhash64("a", "ak"), "parts").cast("int")
    members = join_some_hot(edges, sizes, ["b", "bk"], edges.count()).withColumn("part", part).join(left, ["a", "ak"]).withColumn("member", F.lit(True))
    heads = sizes.join(right, ["b", "bk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"a": F.col("b"), "member": F.lit(False)})
    both = members.select(*rows).unionAll(heads.select(*rows))
    return both.repartition("b", "bk", "part").sortWithinPartitions("b", "bk", "part", "member").mapInArrow(_similar(threshold), "a long, b long")


def _same_document(named: DataFrame, heads: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of texts that stand under one doc_id."""
    spread = named.groupBy("doc_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("t1", "t2") for n, f in (("low", F.min), ("high", F.max))))
    several = spread.where("low_t1 < high_t1 or low_t2 < high_t2").select("doc_id")
    own = named.select("doc_id", "t1", "t2").join(several, "doc_id").join(heads.select("t1", "t2", "node"), ["t1", "t2"]).select("doc_id", "node").distinct()
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
    return own.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class: one document of each. Rows without doc_id stay."""
    classes = near_duplicate_classes(docs, threshold, bands, rows)
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")

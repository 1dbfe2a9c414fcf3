"""Collocations from depth-limited count tries.

1. Each shard of documents (about ``SHARD`` bytes of text) grows a trie of its word sequences for each language, to one depth. A node is kept
   only if its parent and its suffix link (the same words without the last, or the first) passed at the depth before: a phrase is
   never more frequent than its parts, so no phrase that counts is lost.
2. A trie is serialised as sorted rows (path, count). Prefix ranges are dealt over tasks, sorted, and the runs that meet there are merged: equal
   paths stand side by side. What reaches the least count is the merged trie of that depth; a bitmap of fixed size, which may admit too
   much but never too little, tells the shards of the next depth which nodes to grow.
3. In the merged tries a node's parents give the counts of its left parts, its suffix links those of its right parts.

A word stands in paths as a 64-bit hash of language and word. The merge of the first depth sees every word beside its hash
and stops with an error if two words share one, so counts are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import join_some_hot, materialise, portions

#: Bytes of text behind one trie; a longer text is a trie of its own. Bits of the bitmaps.
SHARD, BITS = 1 << 23, 26
#: Bytes of text that are held as words at a time.
TOGETHER = 1 << 20
#: Hash seed, to be changed if two words share a hash.
SEED = 0
RANKING_GROUPS = 64
#: A-Z become a-z; ends of pieces become full stops.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")


def _path(depth: int) -> list[str]:
    return [f"p{k}" for k in range(1, depth + 1)]


def _mixed(path: list[np.ndarray]) -> np.ndarray:
    """One number for a path, each word's hash rotated by its place."""
    return reduce(lambda k, p: ((k >> np.uint64(7)) | (k << np.uint64(57))) ^ p, path)


def _mixed_column(path: list[str]) -> Column:
    turn = lambda k: F.shiftrightunsigned(k, 7).bitwiseOR(F.shiftleft(k, 57))
    return reduce(lambda k, p: turn(k).bitwiseXOR(F.col(p)), path[1:], F.col(path[0]))


def admitting_bitmap(nodes: DataFrame, path: list[str], bits: int = BITS) -> np.ndarray:
    """A bitmap with the places of all ``nodes``; it has ``2**bits`` bits, however many nodes there are."""
    place = _mixed_column(path).bitwiseAND(F.lit((1 << bits) - 1))
    words = nodes.select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("w"))
    found, bitmap = words.toArrow(), np.zeros(max(1, (1 << bits) // 64), np.uint64)
    bitmap[found.column("at").to_numpy()] = found.column("w").to_numpy().view(np.uint64)
    return bitmap


def _admitted(bitmap: np.ndarray, path: list[np.ndarray]) -> np.ndarray:
    place = _mixed(path) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _numbered(texts: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    """The numbers of all words, one text after another, with 0 where a piece ends; only some texts at a time are held as words."""
    parts, start, size = [np.empty(0, np.int32)], 0, 0
    for k, text in enumerate(texts, 1):
        size += len(text)
        if size > TOGETHER or k == len(texts):
            tokens = b".".join(texts[start:k]).translate(_FOLD).replace(b".", b" . ").split()
            parts += [np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)), np.zeros(1, np.int32)]
            start, size = k, 0
    return np.concatenate(parts)


def count_trie(texts: list[bytes], lang: str, depth: int, bitmap: np.ndarray | None = None, seed: int = SEED) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """The nodes of one depth of a trie: their paths (a column of hashes for each word) in sorted order, their counts, and at depth 1 their words."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    numbers[b"."]  # the end of a piece, number 0
    ids = _numbered(texts, numbers)
    start = lang.encode("utf-8", "surrogatepass") + b"\0"
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(start + w, seed) for w in numbers), np.uint64, len(numbers))
    if depth == 1:
        order = np.argsort(hashes[1:]) + 1
        words = list(numbers)
        return [hashes[order]], np.bincount(ids, minlength=len(numbers))[order], [words[k] for k in order]
    # whether the path of depth - 1 that begins at each place is a node to grow from
    last = len(ids) - depth + 1
    if last < 1:
        return [np.empty(0, np.uint64)] * depth, np.empty(0, np.int64), []
    whole = reduce(np.logical_and, [ids[k : k + last + 1] > 0 for k in range(depth - 1)])
    if depth == 2:
        known = _admitted(bitmap, [hashes])[ids[: last + 1]] & whole
    else:
        known = np.zeros(last + 1, bool)
        known[whole] = _admitted(bitmap, [hashes[ids[k : k + last + 1][whole]] for k in range(depth - 1)])
    at = np.flatnonzero(known[:-1] & known[1:])
    # level by level, a node is its parent's number and its word's; ``first`` is a place where it occurs
    node = ids[at].astype(np.int64)
    for k in range(1, depth):
        _, first, node, n = np.unique(node * len(numbers) + ids[at + k], return_index=True, return_inverse=True, return_counts=True)
    path = [hashes[ids[at[first] + k]] for k in range(depth)]
    order = np.lexsort(path[::-1])
    return [p[order] for p in path], n[order], []


def _tries(depth: int, bitmap, seed: int, shard: int):
    names = [*_path(depth), "f", *(["lang", "word"] if depth == 1 else [])]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        size = 0
        for batch in batches:
            for part in portions(batch, 1, rows=1 << 20, size=shard):
                texts = part.column(1).to_pylist()
                for lang, text in zip(part.column(0).to_pylist(), texts):
                    held[lang].append(text)
                size += sum(map(len, texts))
                if size >= shard:
                    yield held
                    held, size = defaultdict(list), 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admitted = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        for held in shards(batches):
            for lang, texts in held.items():
                path, n, words = count_trie(texts, lang, depth, admitted, seed)
                columns = [pa.array(p.view(np.int64)) for p in path] + [pa.array(n, pa.int64())]
                if depth == 1:  # with the root, which counts all words
                    columns[0] = pa.concat_arrays([pa.array([0], pa.int64()), columns[0]])
                    columns[1] = pa.concat_arrays([pa.array([int(n.sum())], pa.int64()), columns[1]])
                    columns += [pa.array([lang] * len(columns[0]), pa.string()), pa.array([None, *words], pa.binary()).cast(pa.string())]
                whole = pa.RecordBatch.from_arrays(columns, names=names)
                for k in range(0, whole.num_rows, 1 << 16):
                    yield whole.slice(k, 1 << 16)

    return run


def _merge(depth: int, least: int):
    """Equal paths of sorted runs stand side by side and are added up; the last path of a batch waits for the next batch."""
    keys = [*_path(depth), *(["lang", "word"] if depth == 1 else [])]

    def groups(table: pa.Table) -> np.ndarray:
        """Where a new path begins."""
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for name in keys:
            c = table.column(name)
            if name.startswith("p"):
                v = c.to_numpy()
                new[1:] |= v[1:] != v[:-1]
            else:
                v = c.to_pylist()
                new[1:] |= np.fromiter((a != b for a, b in zip(v[1:], v[:-1])), bool, max(0, len(v) - 1))
        return np.flatnonzero(new)

    def merged(table: pa.Table) -> pa.Table:
        at = groups(table)
        total = np.add.reduceat(table.column("f").to_numpy(), at) if len(at) else np.empty(0, np.int64)
        return table.take(pa.array(at)).set_column(table.schema.get_field_index("f"), "f", pa.array(total, pa.int64()))

    def check(table: pa.Table) -> None:
        """Neighbours with one hash must be one word (or roots)."""
        p, root = table.column("p1").to_numpy(), np.array(table.column("word").is_null())
        if ((p[1:] == p[:-1]) & ~root[1:] & ~root[:-1]).any():
            raise ValueError("two words share a hash: choose another seed")

    def kept(table: pa.Table) -> Iterator[pa.RecordBatch]:
        wanted = table.column("f").to_numpy() >= least
        if depth == 1:
            wanted |= np.array(table.column("word").is_null())
        yield from table.filter(pa.array(wanted)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = merged(pa.concat_tables([waiting, table]) if waiting is not None else table)
            if depth == 1:
                check(table)
            waiting = table.slice(table.num_rows - 1)
            if table.num_rows > 1:
                yield from kept(table.slice(0, table.num_rows - 1))
        if waiting is not None:
            yield from kept(waiting)

    return run


def merged_tries(texts: DataFrame, depth: int, least: int, bitmap=None, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """Nodes of ``depth`` that occur ``least`` times or more (of depth 1 also each language's root, whose word is null), from (lang, text as binary)."""
    kind = ", ".join(f"{p} long" for p in _path(depth)) + ", f long" + (", lang string, word string" if depth == 1 else "")
    rows = texts.mapInArrow(_tries(depth, bitmap, seed, shard), kind)
    order = [*_path(depth), *(["lang", "word"] if depth == 1 else [])]
    # ranges by the first two words: one common first word doesn't fill a range
    ranges = F.shiftrightunsigned(_mixed_column(_path(min(depth, 2))), 40)
    return rows.repartition(ranges).sortWithinPartitions(*order).mapInArrow(_merge(depth, least), kind)


def _linked(nodes: DataFrame, shorter: DataFrame, depth: int) -> DataFrame:
    """Nodes of ``depth`` with their words and the counts of their left parts, by the parent, and of their right parts, by the suffix link."""
    rows = nodes.count()

    def by(left: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
        uses = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
        right = shorter.select(*[F.col(p).alias(k) for p, k in zip(_path(depth - 1), keys)], *[c.alias(n) for n, c in columns.items()])
        return join_some_hot(left, materialise(right.join(uses, keys)), keys, rows)

    path = _path(depth)
    up = by(nodes, path[:-1], {"lang": F.col("lang"), "start": F.col("words"), "pf": F.col("f"), "pl": F.col("lefts")})
    both = by(up, path[1:], {"end": F.element_at("words", -1), "sf": F.col("f"), "sr": F.col("rights")})
    return both.select(*path, "f", "lang", F.concat("start", F.array("end")).alias("words"), F.concat("pl", F.array("pf")).alias("lefts"), F.concat(F.array("sf"), "sr").alias("rights"))


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, max_words: int = 3, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """Every phrase of 2 to ``max_words`` words that occurs ``least`` times in its language, with the score of its weakest cut.

    Columns: lang, words, a (the phrase's count), l and r (those of the parts at the cut with the lowest score, of equal ones the first), n (all words of
    the language), score (floor of a million times a*a / (l*r)), kept: false where a longer phrase with ``covered`` percent of a or more contains it.

    Null langs count as ``und``, null texts as empty; rows that repeat count as often as they occur; empty tables give no phrases. Long texts are read whole.
    Other columns than lang and text aren't read. Counts up to 10**13 are exact.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    first = materialise(merged_tries(texts, 1, least, seed=seed, shard=shard))
    totals = first.where("word is null").select("lang", F.col("f").alias("n"))
    level = first.where("word is not null").select("p1", "f", "lang", F.array("word").alias("words"), *[F.array().cast("array<long>").alias(c) for c in ("lefts", "rights")])
    levels = []
    for depth in range(2, max_words + 1):
        bitmap = spark.sparkContext.broadcast(admitting_bitmap(level, _path(depth - 1)).tobytes())
        nodes = materialise(merged_tries(texts, depth, least, bitmap, seed, shard))
        level = materialise(_linked(nodes, level, depth))
        levels.append(level)
    done = []
    for depth, nodes in enumerate(levels, 2):
        if depth < max_words:  # the most frequent phrase that has one word more, before or after
            longer, path = levels[depth - 1], _path(depth + 1)
            ends = [longer.select(*[F.col(p).alias(q) for p, q in zip(some, _path(depth))], "f") for some in (path[:-1], path[1:])]
            nodes = nodes.join(ends[0].unionAll(ends[1]).groupBy(*_path(depth)).agg(F.max("f").alias("longer")), _path(depth), "left")
        else:
            nodes = nodes.withColumn("longer", F.lit(None).cast("long"))
        done.append(nodes.select("lang", "words", "f", "lefts", "rights", F.expr(f"coalesce(100 * longer < {covered} * f, true)").alias("kept")))
    wide = "CAST({} AS DECIMAL(13, 0))".format
    score = f"(({wide('f')} * {wide('f')}) * 1000000) DIV ({wide('x.lefts')} * {wide('x.rights')})"
    cuts = F.expr(f"transform(arrays_zip(lefts, rights), (x, k) -> struct({score} AS score, k AS k, x.lefts AS l, x.rights AS r))")
    scored = reduce(DataFrame.unionAll, done).withColumn("cut", F.array_min(cuts))
    return scored.join(totals, "lang").select("lang", "words", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", "kept")


def top_collocations(phrases: DataFrame, k: int = 2000) -> DataFrame:
    """Each language's first ``k`` kept phrases by score, count and phrase (UTF-8 byte order); groups of a language rank theirs first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    named = phrases.where("kept").select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "n", "score")
    grouped = named.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(RANKING_GROUPS)))
    best = grouped.withColumn("place", F.row_number().over(W.partitionBy("lang", "group").orderBy(*order))).where(F.col("place") <= k)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= k)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

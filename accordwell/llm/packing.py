"""Packing tokenised documents into fixed-length sequences.

Documents are cut into full sequences and a rest. Rests are packed first-fit decreasing,
with a tournament tree over the bins' free room, in randomised groups of documents that
are independent of one another; so a group is one small task and nothing is global.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 2
CHUNK = "doc_id long, doc_tokens long, salt long, crcs array<long>, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, with a bounded memory of words.

    The tokenizer splits at white space and drops it, so a text's ids are those of its
    white-space-free chunks; only chunks that were not seen before go to the tokenizer. A final
    punctuation mark after a letter is a token run of its own, and ASCII words don't depend on case, so
    such chunks share the ids of their stem.
    """

    REMEMBER, PORTION = 1_000_000, 1000
    FINAL = frozenset(".,;:!?")

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, bytes] = {"": b""} | {c: self._one(c) for c in self.FINAL}

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, chunk: str) -> tuple[str, str]:
        stem, mark = chunk, ""
        # letters below U+0250, but for one, stay single letters in normal form and lower case
        if len(chunk) > 1 and chunk[-1] in self.FINAL and chunk[-2].isalpha() and "\u0250" > chunk[-2] != "\u0130":
            stem, mark = chunk[:-1], chunk[-1]
        return stem.lower() if stem.isascii() and "<" not in stem else stem, mark

    def learn(self, chunks: set[str]) -> None:
        seen, plain, odd, shared = self.seen, [], [], []
        for c in chunks:
            if c.islower() and c.isalpha():
                plain.append(c)
            else:
                shared.append((c, *self._stem(c)))
        for stem in {s for _, s, _ in shared}:
            if stem not in seen and not (stem in chunks and stem.islower() and stem.isalpha()):
                (plain if stem.isalpha() else odd).append(stem)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            # a word of letters only is one run, whose last token alone ends a word
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(some):  # lower case has added a mark to a letter
                odd += some
                continue
            raw = ids.tobytes()
            seen.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                seen[word] = np.array(e.ids, "<u4").tobytes()
        for chunk, stem, mark in shared:
            seen[chunk] = seen[stem] + seen[mark]

    def encode(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text, null as empty. Arrow splits the texts and finds the distinct chunks."""
        for k in range(0, len(texts), self.PORTION):
            if len(self.seen) > self.REMEMBER:
                self.forget()
            chunks = pc.ascii_split_whitespace(texts.slice(k, self.PORTION).fill_null(""))
            coded = chunks.values.dictionary_encode()
            words = coded.dictionary.to_pylist()
            self.learn({w for w in words if w not in self.seen})
            ids = pa.array(map(self.seen.__getitem__, words), pa.large_binary()).take(coded.indices)
            cuts = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][chunks.offsets.to_numpy()].tolist()
            raw = (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
            yield from map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item, for items in decreasing order of length.

    A tournament tree holds the most free room below each node; the walk down from the
    root goes left wherever the item fits, and so ends at the first bin with room.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins.append(node - leaves)
        room[node] -= n
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, group_docs: int = 8192, keep_ids: bool = False
) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text; other columns are ignored).

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32 of
    its ids as little-endian unsigned 32-bit, doc_tokens (with the end id), sequence_id, offset
    in the sequence; with ``keep_ids`` also the ids themselves (array of int). A null or
    empty text still has its end id. Repeated rows are packed once each; a null doc_id stays
    null. An empty table gives an empty result. A very long text is cut into pieces, each of
    a sequence at most; its ids are made in portions.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, salt, step = WordIds(tokenizer_path), 0, 4 * capacity
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                counts, crcs, ids = [], [], []
                for raw in words.encode(part.column(1)):
                    raw += end
                    counts.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[i : i + step]) for i in range(0, len(raw), step)])
                    ids.append(raw if keep_ids else None)
                salts = np.arange(salt, salt + part.num_rows)
                salt += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(salts), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.binary())],
                    names=["doc_id", "doc_tokens", "salt", "crcs", "ids"],
                )

    def pack(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        first = key[0].as_py() << 32
        rows = group.to_pydict()
        pieces = []
        for i, total in enumerate(rows["doc_tokens"]):
            for k, start in enumerate(range(0, total, capacity)):
                pieces.append((-min(capacity, total - start), rows["doc_id"][i] or 0, rows["crcs"][i][k], i, start))
        pieces.sort()
        bins = first_fit_decreasing([-p[0] for p in pieces], capacity)
        filled: dict[int, int] = {}
        out: dict[str, list] = {n.split()[0]: [] for n in PIECE.split(", ")} | ({"ids": []} if keep_ids else {})
        for (minus, _, crc, i, start), b in zip(pieces, bins):
            at = filled.get(b, 0)
            filled[b] = at - minus
            row = [rows["doc_id"][i], start, -minus, crc, rows["doc_tokens"][i], first + b, at]
            if keep_ids:
                row.append(np.frombuffer(rows["ids"][i], "<u4")[start : start - minus].astype(np.int32))
            for name, value in zip(out, row):
                out[name].append(value)
        return pa.table({n: pa.array(v, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, v in out.items()})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = max(1, round(narrow.count() / group_docs))
    tokens = narrow.mapInArrow(tokenise, CHUNK)
    dealt = tokens.withColumn("deal", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(pack, PIECE + (", ids array<int>" if keep_ids else ""))

"""Encoding and decoding with a SentencePiece BPE model, by vectorised merge rounds.

The text becomes words (a run of space marks and what follows up to the next mark); no
piece has a mark after another character, so words never influence one another. The
symbols of many words lie in one flat array. Each round finds every word's lowest pair
rank by a segmented minimum, merges all its occurrences at once from the left,
and compacts the array, until no word has a pair left.

Merging all occurrences at once equals the library's one-at-a-time order unless a fresh
piece could at once take part in a pair of the same or a lower rank. Pieces for which the vocabulary
allows that are found when the model is loaded; of those, only the leftmost occurrence is
merged in a round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NO_RANK = np.int32(2**31 - 1)
SPLIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """The tables that merge rounds need, read from a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece has a space mark after another character: words can't be taken apart")
        scores = np.array([sp.get_score(i) for i in range(size)])
        # equal scores get equal ranks, the best score rank 0
        ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_of = {}
        for i in range(size):
            if sp.is_byte(i):
                value = int(self.pieces[i][3:-1], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
        self.char_id = np.full(0x110000, -1, np.int32)
        left, right, merged = [], [], []
        tied = np.bincount(ranks)[ranks] > 1
        self.one_at_a_time = np.zeros(size + 1, bool)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
                continue
            self.one_at_a_time[i] |= tied[i]
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
                    for part in (a, b):
                        self.one_at_a_time[part] |= ranks[i] <= ranks[part]
        self.rank_of = np.append(ranks, NO_RANK)  # index -1: no pair
        self.size = size
        self.plain = [p.replace(MARK, " ") for p in self.pieces]
        self.is_byte = np.isin(np.arange(size), list(self.byte_of))
        self.decimal = list(map(str, range(size)))
        self._hash(np.array(left, np.int64) * size + np.array(right), np.array(merged, np.int32))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A table of pairs with linear probing, filled and read by whole arrays."""
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs make, -1 where they make none."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out, found = self.values[slot], self.keys[slot]
        todo = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = -1
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            todo, slot = todo[go], slot[go]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word) of non-empty words."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), lens)
        sym = self.char_id[code]
        code = code.astype(np.int64)
        pair = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.merged(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = self.rank_of[pair]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == NO_RANK, sizes)
            if over.any():
                done.append((word[over], sym[over], code[over]))
                go = ~over
                word, sym, code, pair, rank = word[go], sym[go], code[go], pair[go], rank[go]
                sizes, least = sizes[least != NO_RANK], least[least != NO_RANK]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # of a run of overlapping occurrences every other one, from the left
            fresh = np.append(True, np.diff(at) != 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            first = np.append(True, word[at[1:]] != word[at[:-1]])
            at = at[((np.arange(len(at)) - run) % 2 == 0) & (first | ~self.one_at_a_time[pair[at]])]
            sym[at] = pair[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # where the merged symbols are after compaction
            word, sym, code, pair = word[keep], sym[keep], code[keep], pair[keep]
            near = np.zeros(len(sym), bool)
            near[new] = True
            near[new[new > 0] - 1] = True
            touched = np.flatnonzero(near)
            ends = (touched == len(sym) - 1) | (word[np.minimum(touched + 1, len(sym) - 1)] != word[touched])
            pair[touched[ends]] = -1
            touched = touched[~ends]
            pair[touched] = self.merged(sym[touched], sym[touched + 1])
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word, sym, code = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        word, sym, code = word[order], sym[order], code[order]
        if (sym < 0).any():  # characters that the vocabulary lacks become their UTF-8 bytes
            width = np.where(sym >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
            raw = np.frombuffer("".join(map(chr, code[sym < 0])).encode("utf-8", "surrogatepass"), np.uint8)
            out = np.repeat(sym, width)
            out[np.repeat(sym < 0, width)] = self.byte_ids[raw]
            sym, word = out, np.repeat(word, width)
        return sym, np.bincount(word, minlength=len(words))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space mark that the library puts first is still there as a space."""
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.plain[i].encode() for i in ids)
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def split_words(text: str) -> list[str]:
    """The words of a text, space marks for spaces, with the mark that the library puts first."""
    return SPLIT.findall(MARK + text.replace(" ", MARK)) if text else []


class Codec:
    """Encodes and decodes texts; remembers the words it has seen, up to a bound."""

    BLOCK, REMEMBER = 1 << 15, 300_000

    def __init__(self, path: str) -> None:
        self.model = load_model(path)
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.ids) > self.REMEMBER:
            self.ids.clear()
            self.text.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        for k in range(0, len(new), self.BLOCK):
            part = new[k : k + self.BLOCK]
            ids, counts = self.model.encode_words(part)
            ends = np.cumsum(counts)
            bytes_in = np.add.reduceat(self.model.is_byte[ids], ends - counts) > 0
            ends, own = ends.tolist(), ids.tolist()
            numbers, texts = [[*map(x.__getitem__, own)] for x in (self.model.decimal, self.model.plain)]
            at = 0
            for w, to, raw in zip(part, ends, bytes_in.tolist()):
                self.ids[w] = ",".join(numbers[at:to])
                self.text[w] = self.model.decode(own[at:to]) if raw else "".join(texts[at:to])
                at = to

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids in decimal joined by commas, decoded text) of each text, in order."""
        k = 0
        while k < len(texts):
            some, chars = [], 0
            while k < len(texts) and (not some or chars + len(texts[k]) < 1_000_000):
                some.append(split_words(texts[k]))
                chars += len(texts[k])
                k += 1
            self.learn([w for words in some for w in words])
            for words in some:
                yield ",".join(map(self.ids.__getitem__, words)), "".join(map(self.text.__getitem__, words))[1:]


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("decoded", T.StringType()),
    ]
)
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """Encode whole texts and decode them again.

    ``docs`` needs doc_id and text; other columns are ignored. Returns per row doc_id,
    n_tokens, ids (decimal, comma-joined) and decoded; with ``digests`` the SHA-256 of the
    last two instead. A null text counts as empty: no ids, empty decoded text. A null
    doc_id stays null, repeated rows are each encoded. A very long text is encoded whole, in
    memory in proportion to it. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                counts, ids, texts = [], [], []
                for own, text in codec.encode_decode([t or "" for t in part.column(1).to_pylist()]):
                    counts.append(own.count(",") + 1 if own else 0)
                    ids.append(hashlib.sha256(own.encode()).hexdigest() if digests else own)
                    texts.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if digests else text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, DIGESTS if digests else SCHEMA)

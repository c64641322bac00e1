"""Byte-level BPE: batched numpy merge rounds over the symbols of many words at once, and decoding.

Short words take a few rounds, each over all their symbols. Long ones would take thousands: for those, places are kept by the rank of
their pair, and a round touches only what it merges and the neighbours. The vocabulary's place is a parameter; each task reads it once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import tidied

#: Fixed value: the pattern that cuts a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEPT_WORDS = 300_000
#: Bytes from which a word is long.
_LONG = 256


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + n)
    return out


class BytePairs:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * top
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        #: Pair keys in order, and the rank and the merged symbol of each.
        self.keys, self.rank = keys[order], order
        merged = np.array([vocab["".join(p)] for p in pairs], dtype=np.int64)
        self.merged = merged[order]
        self.by_rank = np.stack([left, right, merged], axis=1)
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, str] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Symbols of each word after all merges.

        One flat array holds all words' symbols. In a round every word merges its pair of lowest rank, at
        all its places from the left; words without a ranked pair drop out.
        """
        size = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(words)
        never = len(self.keys)
        while len(sym):
            inside = np.r_[word[1:] == word[:-1], False]
            key = np.where(inside, (sym << 32) | np.r_[sym[1:], 0], -1)
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], never)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(sym)])
            for k in np.flatnonzero(best == never):
                done[word[start[k]]] = sym[start[k] : start[k] + length[k]]
            hit = (rank == np.repeat(best, length)) & (rank < never)
            # Of places that overlap (the same symbol in a run), every other one merges, from the left.
            place = np.flatnonzero(hit)
            if len(place):
                run = np.r_[True, np.diff(place) != 1]
                since = np.arange(len(place)) - np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
                place = place[since % 2 == 0]
            gone = np.zeros(len(sym), dtype=bool)
            sym[place] = self.merged[at[place]]
            gone[place + 1] = True
            keep = ~gone & np.repeat(best < never, length)
            sym, word = sym[keep], word[keep]
        return done

    def merge_long(self, words: list[bytes]) -> list[np.ndarray]:
        """As ``merge``, for words of any length: time follows the number of merges, not rounds times length.

        Rounds go by rank over all words together, lowest first: a word sees its own merges in the same order as alone, since
        a merge of rank r in one word waits for lower ones in others, which don't touch it.
        """
        size = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(sym)
        if not n:
            return [np.zeros(0, dtype=np.int64)] * len(words)
        ends = np.cumsum(size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[size > 0] - 1] = -1  # no neighbour across words
        before[(ends - size)[size > 0]] = -1
        never = len(self.keys)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(at: np.ndarray) -> None:
            """File the pairs that start at these places."""
            at = at[after[at] >= 0]
            key = (sym[at] << 32) | sym[after[at]]
            k = np.minimum(np.searchsorted(self.keys, key), never - 1)
            hit = self.keys[k] == key
            rank, at = self.rank[k[hit]], at[hit]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, part in zip(rank[cut].tolist() if len(rank) else (), np.split(at, cut[1:]) if len(rank) else (), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(part)

        look_up(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            filed = places.pop(r)
            at = filed[0] if len(filed) == 1 else np.concatenate(filed)
            left, right, into = self.by_rank[r]
            # Pairs that are no longer there have lost a symbol.
            there = (sym[at] == left) & (after[at] >= 0)
            at = at[there]
            at = at[sym[after[at]] == right]
            if left == right and len(at):
                at = np.unique(at)
                # In a run of one symbol every other pair merges, from the left.
                run = np.r_[True, after[at[:-1]] != at[1:]]
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            if not len(at):
                continue
            lost = after[at]
            sym[at], sym[lost] = into, -1
            then = after[lost]
            after[at] = then
            after[lost] = -1
            before[then[then >= 0]] = at[then >= 0]
            prior = before[at]
            look_up(np.unique(np.r_[at, prior[prior >= 0]]))
        out = []
        for a, b in zip(ends - size, ends, strict=True):
            part = sym[a:b]
            out.append(part[part >= 0])
        return out

    def learn(self, words: set[str]) -> None:
        """Ids of words not met before, as text: '1,2,3'."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > _KEPT_WORDS:
            self.known.clear()
            new = list(words)
        new.sort(key=len)
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        long = next((i for i, w in enumerate(new) if 4 * len(w) > _LONG), len(new))
        for a in range(0, long, 20_000):
            self._keep(new[a : min(a + 20_000, long)], self.merge(coded[a : min(a + 20_000, long)]))
        if long < len(new):
            self._keep(new[long:], self.merge_long(coded[long:]))

    def _keep(self, words: list[str], ids: list[np.ndarray]) -> None:
        for w, x in zip(words, ids, strict=True):
            self.known[w] = ",".join(map(str, x.tolist()))

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text between special tokens, and those: (piece, special)."""
        if self.marks is None or not any(t in text for t in self.special):
            return [(text, False)]
        out, end = [], 0
        for m in self.marks.finditer(text):
            out += [(text[end : m.start()], False)] * (m.start() > end) + [(m.group(), True)]
            end = m.end()
        return out + [(text[end:], False)] * (end < len(text))

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Comma-joined ids of each text, words new to this task merged together first."""
        cut = [[(str(self.special[p]), None) if s else (None, self.words.findall(p)) for p, s in self.pieces(t)] for t in texts]
        self.learn({w for parts in cut for _, ws in parts if ws for w in ws})
        known = self.known
        return [",".join([x for mark, ws in parts for x in ([mark] if ws is None else map(known.__getitem__, ws))]) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> BytePairs:
    return BytePairs(path)


def _batches(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``docs`` with an array ``column`` of the text's token ids; a null or empty text has none.

    Special tokens in a text become their ids, as the library does. Rows are independent: repeated rows are encoded alike and an empty table
    gives an empty result. All other columns stay; one named ``column`` is replaced, in its place. A text is worked through whole, a very long word in time
    that follows its merges.
    """
    where = [c for c in docs.columns if c != column]

    def run(batches):
        coder = loaded(path)
        for batch in batches:
            ids = [[int(x) for x in row.split(",")] if row else [] for part in _batches(batch.column("text").to_pylist()) for row in coder.encode_batch(part)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in where), pa.array(ids, pa.list_(pa.int32()))], names=[*where, column])
        coder.known.clear()

    _once(docs)
    return docs.mapInArrow(tidied(run), _with(docs, column, T.ArrayType(T.IntegerType()))).select(*(docs.columns if column in docs.columns else [*docs.columns, column]))


def decode(tokens: DataFrame, path: str, column: str = "ids", into: str = "text") -> DataFrame:
    """``tokens`` with the text of the array ``column`` as ``into``; a null or empty array gives an empty text.

    All other columns stay; one named ``into`` is replaced, in its place. Rows are independent, of any length; an empty table gives an empty result.
    """
    where = [c for c in tokens.columns if c != into]

    def run(batches):
        coder = loaded(path)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in where), pa.array(texts, pa.string())], names=[*where, into])

    _once(tokens)
    return tokens.mapInArrow(tidied(run), _with(tokens, into, T.StringType())).select(*(tokens.columns if into in tokens.columns else [*tokens.columns, into]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the text encoded, and its ids decoded again.

    Both in one pass over the texts; the decoded text is built from the ids alone. A null or empty text has no tokens. Rows are independent: null ids
    stay, repeated rows each come back and an empty table gives an empty result; columns beside doc_id and text are ignored, whatever their names. Texts are
    worked through whole, however long.
    """

    def run(batches):
        coder = loaded(path)
        for batch in batches:
            rows = []
            ids = (row for part in _batches(batch.column("text").to_pylist()) for row in coder.encode_batch(part))
            for doc_id, row in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                numbers = np.fromstring(row, dtype=np.int64, sep=",").tolist() if row else []
                rows.append((doc_id, len(numbers), hashlib.sha256(row.encode()).hexdigest(), hashlib.sha256(coder.decode(numbers).encode()).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.known.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _once(df: DataFrame) -> None:
    if len(set(df.columns)) < len(df.columns):
        raise ValueError(f"columns must have different names: {df.columns}")

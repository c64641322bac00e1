"""Benchmark decontamination: windows of benchmark words found in documents by Wu-Manber search over words.

A text is its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z. Every ``window`` consecutive words of an item are a test
string; an item of fewer words is one test string. Strings of one length are searched for together:

* the shift table holds, for a hash of each two-word block of a test string, how far the block lies from the string's end at least;
  a block that isn't there moves the search on by all but one word of the string,
* where the shift is 0, the bucket of the block's hash (with one of all words) gives the test strings,
* their bytes are compared with the text's.

Many places of a batch are looked at side by side (numpy); documents are neither shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A byte's place in the text's words: letters, digits and all beyond ASCII stay, the rest is a space. 255 is kept for the gaps between documents.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 254 if b == 255 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = b" \xff "
#: Windows that start in a piece of an item.
_PIECE = 4096
#: Words between two places where the search starts.
_LANE = 64
#: Bytes hashed at a time, and bytes of text searched at a time.
_SLICE, _CHUNK = 1 << 20, 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)

OVERLAP = "struct<n_words: long, n_hit: long, hits: array<struct<first: long, last: long>>, items: array<string>>"


def words(text: Column) -> Column:
    """The words of a whole text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _powers(n: int, of: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, of, np.uint64))])


_LOW = _powers(1 << 16, _ODD)


class Words:
    """Words of a buffer of plain bytes: where they start and end, and a 64-bit hash of each."""

    def __init__(self, plain: bytes):
        self.plain = plain
        buf = np.frombuffer(plain, np.uint8)
        inside = buf != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        self.gap = np.flatnonzero(buf[self.start] == 255)
        self.hash = self._hashes(buf[inside], self.end - self.start)

    @staticmethod
    def _hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A sum over each word's bytes, so a word may go on from one slice to the next."""
        out = lengths.astype(np.uint64)
        at = np.cumsum(lengths) - lengths
        high = _powers((int(lengths.max(initial=0)) >> 16) + 1, (_LOW[-1:] * _ODD)[0])
        for a in range(0, len(letters), _SLICE):
            b = min(a + _SLICE, len(letters))
            first, last = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
            place = np.arange(a, b) - np.repeat(at[first:last], np.minimum(at[first:last] + lengths[first:last], b) - np.maximum(at[first:last], a))
            value = _BYTE[letters[a:b]] * _LOW[place & 0xFFFF] * high[place >> 16]
            out[first:last] += np.add.reduceat(value, np.maximum(at[first:last], a) - a)
        return (out ^ (out >> np.uint64(29))) * _ODD

    def text(self, first: int, n: int) -> bytes:
        raw = self.plain[self.start[first] : self.end[first + n - 1]]
        return raw if b"  " not in raw else b" ".join(raw.split())

    def block(self, end: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the blocks of ``size`` words that end at the places ``end``."""
        h = self.hash[end]
        return h if size == 1 else (h + (self.hash[end - 1] >> np.uint64(7))) * _ODD

    def key(self, end: np.ndarray, n: int, size: int) -> np.ndarray:
        """Bucket of the strings of ``n`` words that end at ``end``: the last block's hash above, one of all words below."""
        whole = np.zeros(len(end), np.uint64)
        for k in range(n):
            whole = (whole + self.hash[end - k]) * _ODD
        return (self.block(end, size) >> np.uint64(32) << np.uint64(32)) | (whole >> np.uint64(32))


class SameLength:
    """Test strings of ``n`` words: shift table, buckets, and the items that each string is from."""

    def __init__(self, of: Words, ends: np.ndarray, items: np.ndarray, n: int):
        self.n, self.size, self.of = n, min(2, n), of
        bits = min(max(int(16 * len(ends)).bit_length(), 12), 26)
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, n - self.size + 1, np.uint8)
        for left in range(n - self.size, -1, -1):  # nearer ends come later and stay
            self.shift[self._slot(of, ends - left)] = left
        key = of.key(ends, n, self.size)
        order = np.argsort(key, kind="stable")
        self.keys, self.ends, self.items = [], [], []
        same: dict[bytes, int] = {}
        last = None
        for k, end, item in zip(key[order].tolist(), ends[order].tolist(), items[order].tolist(), strict=True):
            if k != last:
                same, last = {}, k
            text = of.text(end - n + 1, n)
            if text not in same:
                same[text] = len(self.keys)
                self.keys.append(k)
                self.ends.append(end)
                self.items.append(set())
            self.items[same[text]].add(item)
        self.keys = np.array(self.keys, np.uint64)

    def _slot(self, of: Words, end: np.ndarray) -> np.ndarray:
        return of.block(end, self.size) >> self.down

    def found(self, of: Words) -> Iterator[tuple[int, int]]:
        """(first word, number of the test string) of all occurrences, overlapping ones too."""
        total = len(of.start)
        at = np.arange(0, total, _LANE)
        until = np.minimum(at + _LANE, total)
        at = np.maximum(at, self.n - 1)
        places = []
        while True:
            on = at < until
            at, until = at[on], until[on]
            if not len(at):
                break
            shift = self.shift[self._slot(of, at)]
            places.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
        ends = np.concatenate(places) if places else np.zeros(0, np.int64)
        key = of.key(ends, self.n, self.size)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = np.flatnonzero(high > low)
        for end, a, b in zip(ends[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            text = of.text(end - self.n + 1, self.n)
            for p in range(a, b):
                if text == self.of.text(self.ends[p] - self.n + 1, self.n):
                    yield end - self.n + 1, p
                    break


class Search:
    """All test strings of a block of benchmark pieces."""

    def __init__(self, pieces: list[tuple[str | None, str]], window: int):
        self.names = sorted({name for name, _ in pieces if name is not None})
        number = {name: k for k, name in enumerate(self.names)} | {None: -1}
        of = Words(b"".join(text.encode() + _GAP for _, text in pieces))
        sizes = np.diff(of.gap, prepend=-1) - 1
        item = np.array([number[name] for name, _ in pieces], np.int64)
        self.lengths = []
        for n in sorted(set(np.minimum(sizes, window).tolist()) - {0}):
            some = np.flatnonzero(np.minimum(sizes, window) == n)
            each = sizes[some] - n + 1
            end = np.repeat(of.gap[some] - sizes[some] + n - 1, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            self.lengths.append(SameLength(of, end, np.repeat(item[some], each), n))

    def overlaps(self, texts: list[bytes | None], before: list[dict | None]) -> list[dict]:
        """For each text its words, the runs of hit words and the items found; ``before`` holds what other blocks have found."""
        of = Words(b"".join((t or b"").translate(_PLAIN) + _GAP for t in texts))
        begin = np.concatenate([np.zeros(1, np.int64), of.gap[:-1] + 1])
        edge = np.zeros(len(of.start) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for k, b in enumerate(before):
            if b:
                items[k] |= set(b["items"])
                for hit in b["hits"]:
                    edge[begin[k] + hit["first"]] += 1
                    edge[begin[k] + hit["last"] + 1] -= 1
        for strings in self.lengths:
            hits = list(strings.found(of))
            first = np.array([h[0] for h in hits], np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + strings.n, -1)
            for k, p in {(k, p) for k, (_, p) in zip(np.searchsorted(of.gap, first).tolist(), hits, strict=True)}:
                items[k] |= {self.names[i] for i in strings.items[p] if i >= 0}
        runs = np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False)).reshape(-1, 2)
        out = [{"n_words": n, "n_hit": 0, "hits": [], "items": sorted(found)} for n, found in zip((of.gap - begin).tolist(), items, strict=True)]
        for k, (a, b) in zip(np.searchsorted(of.gap, runs[:, 0]).tolist(), runs.tolist(), strict=True):
            out[k]["hits"].append({"first": a - int(begin[k]), "last": b - 1 - int(begin[k])})
            out[k]["n_hit"] += b - a
        return out


#: The search of the broadcast that this worker used last.
_LAST: list = [None, None]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= _CHUNK:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def pieces_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, piece): items cut into pieces that overlap by a window less one word, so that every window lies in one piece. Repeated rows come once."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(_PIECE)))
    cut = w.select("item", "w", start.alias("s")).select("item", F.array_join(F.slice("w", F.col("s") + 1, F.lit(_PIECE + window - 1)), " ").alias("piece"))
    return cut.distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000, column: str = "overlap") -> DataFrame:
    """``docs`` with a struct ``column`` (n_words, n_hit, hits, items): words, hit words, runs of them (first, last; from 0), ids of items found, sorted as strings.

    A word inside any occurrence of a window is hit. A benchmark of up to ``block_bytes`` of words goes to all tasks; a larger one is dealt into
    as many blocks as it takes, which go over the documents one after the other, each adding to what the others found.

    A null or empty text has no words and no hits, an item without words no windows. An item with a null id hits but can't be listed. Rows are
    independent: null ids stay, repeated rows each come back; repeated items count once. Empty tables on either side do no harm. All other columns stay;
    one named ``column`` is replaced. Texts of any length are searched whole.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    pieces = stored(pieces_of(benchmark, window), "pieces")
    total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    out = docs.drop(column)
    kept = out.columns
    schema = T.StructType([*out.schema.fields, T.StructField(column, T._parse_datatype_string(OVERLAP))])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])
    for block in range(n_blocks):
        rows = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(n_blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(sorted((tuple(r) for r in rows), key=lambda r: (r[0] or "", r[1])))

        def run(batches, sent=sent, block=block):
            if _LAST[0] is not sent:
                _LAST[:] = sent, Search(sent.value, window)
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                before = batch.column(column).to_pylist() if block else [None] * len(texts)
                found = [x for a, b in _chunks(texts) for x in _LAST[1].overlaps(texts[a:b], before[a:b])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], names=[*kept, column])

        out = out.mapInArrow(run, schema)
        if block + 1 < n_blocks:
            out = stored(out, "searched")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, window: int = 10) -> DataFrame:
    """``docs`` of which no more than ``max_share`` of the words are hit; columns stay as they are, rows without words stay."""
    found = overlaps(docs, benchmark, window, column="__overlap")
    return found.where(F.col("__overlap.n_hit") <= F.col("__overlap.n_words") * max_share).drop("__overlap")

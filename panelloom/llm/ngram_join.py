"""Exact Jaccard join on word n-grams: shared-token statistics find candidates, signature trees link them.

How it scales. Every text becomes a set of 64-bit n-gram hashes, identified by a 64-bit fingerprint of the
set, so that equal sets are one set from there on (copies are never paired). The tokens of one half of the
hash space are packed by hash bucket and shuffled once; each bucket finds which of its tokens lie in two sets or more. The number of buckets
follows the input's bytes, and a partition works through its buckets one by one. Tokens that a task meets often don't go to their bucket but
where there is room, with only their counts sent to the bucket, so that a passage of very many texts is never in one place.
With tokens ordered by (other half last, number of sets, hash), two sets that reach the threshold t share a
token among the first n - ceil(t n) + 1 of each (prefix filter). A set whose prefix holds only tokens that no
other set has is done: this clears all but the near-duplicates, whatever passages they quote. The sets left are
grouped by the connected components of "shares a prefix token"; each group builds signature trees
and a dual traversal finds the links. A group above ``block`` sets is dealt over several tasks (see _units).

Hashes: a token is a 64-bit mix of its words' 64-bit hashes. Sets that differ and pairs that are off by a
collision have odds near 1e-15 a pair, which the tests' brute force on words has never shown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import dealt_anew, stored, tidied
from panelloom.llm.components import connected_components
from panelloom.llm.signature_tree import linked

_WEYL = 0x9E3779B97F4A7C15
#: Bytes of text for a bucket and for a partition of buckets, and the least and most bits of a bucket's number.
_BUCKET_BYTES, _PART_BYTES = 1 << 25, 1 << 30
_BITS = (12, 24)
#: A token that so many sets of one flush hold is hot; (token, set) in a row of such; those in memory at a time in a bucket's task.
_HOT, _HOT_ROW, _AT_ONCE = 32, 1024, 1_000_000
_HALF = np.uint64(1 << 63)
_MAX_WORDS_KEPT = 400_000
_FLUSH = 1_500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MAX_WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, n: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct n-gram hashes of the whole text; a shorter text is one token, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the six ASCII spaces
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    last = len(h) - width + 1
    total = np.full(last, width, dtype=np.uint64)
    places = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)  # unrelated odd factors: order counts
    for k in range(width):
        total += h[k : k + last] * places[k]
    return np.unique(_mix(total))


def set_id(tokens: np.ndarray) -> int:
    """Fingerprint of a set, as a signed 64-bit number."""
    return int((_mix(tokens ^ np.uint64(_WEYL)).sum(dtype=np.uint64) + np.uint64(len(tokens))).view(np.int64))


def prefix_length(size: np.ndarray | int, num: int, den: int):
    return size - (num * size + den - 1) // den + 1


_DEALT = pa.schema(
    [("spread", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("sets", pa.binary()), ("counts", pa.binary()), ("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("n_half", pa.int64()), ("rest", pa.list_(pa.int64()))]
)
_DEALT_SQL = "spread long, bucket int, tokens binary, sets binary, counts binary, doc_id long, set_id long, n long, n_half long, rest array<long>"
#: Buckets of rows that are no bucket's: documents, and (token, set) of hot tokens.
_DOCUMENT, _HOT_PAIRS = -1, -2


def _deal(n: int, num: int, den: int, bits: int):
    """One row a document with what is known of its set, and rows of packed (token, set) by hash bucket.

    A token is a bucket's number and 32 bits more. Of one that is hot here the bucket is sent how many sets have it; which do goes into rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        tokens: list[np.ndarray] = []
        owners: list[int] = []
        held = 0
        flush = int(min(max(_FLUSH, 4 << bits), 8_000_000))
        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) * 1_000_003

        def table(rows: list[tuple]) -> pa.RecordBatch:
            """Rows (bucket, tokens, sets, counts), each bucket's where it belongs and the others anywhere."""
            nonlocal place
            bucket, *packs = zip(*rows, strict=True)
            spread = [b if b >= 0 else place + i for i, b in enumerate(bucket)]
            place += len(rows)
            return pa.RecordBatch.from_arrays([pa.array(spread, pa.int64()), pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in packs), *(pa.nulls(len(rows), f.type) for f in list(_DEALT)[5:])], schema=_DEALT)

        def by_bucket(token: np.ndarray) -> Iterator[tuple[int, int, int]]:
            bucket = (token >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=int)
            return zip(bucket[cut].tolist(), cut.tolist(), np.r_[cut[1:], len(bucket)].tolist() if len(bucket) else [], strict=True)

        def packed() -> pa.RecordBatch:
            token = np.concatenate(tokens) >> np.uint64(31 - bits)
            own = np.repeat(np.array(owners, dtype=np.int64), [len(t) for t in tokens])
            order = np.argsort(token)
            token, own = token[order], own[order]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            count = np.diff(np.r_[first, len(token)])
            hot = np.repeat(count >= _HOT, count)
            rows: list[tuple] = []
            if hot.any():
                name, by = token[first[count >= _HOT]], count[count >= _HOT].astype(np.int64)
                low = name.astype(np.uint32)
                rows += [(b, low[i:j].tobytes(), None, by[i:j].tobytes()) for b, i, j in by_bucket(name)]
                pairs = token[hot].astype(np.int64), own[hot]
                rows += [(_HOT_PAIRS, *(x[i : i + _HOT_ROW].tobytes() for x in pairs), None) for i in range(0, len(pairs[0]), _HOT_ROW)]
            token, own = token[~hot], own[~hot]
            low = token.astype(np.uint32)
            rows += [(b, low[i:j].tobytes(), own[i:j].tobytes(), None) for b, i, j in by_bucket(token)]
            return table(rows)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), n, hashes)
                place += 1
                if not len(s):
                    rows.append((place, _DOCUMENT, None, None, None, doc_id, None, 0, 0, None))
                    continue
                key = set_id(s)
                half = s[: np.searchsorted(s, _HALF)]
                lacking = int(prefix_length(len(s), num, den)) - len(half)
                rest = s[len(half) : len(half) + lacking].view(np.int64).tolist() if lacking > 0 else None
                rows.append((place, _DOCUMENT, None, None, None, doc_id, key, len(s), len(half), rest))
                if doc_id is not None and key not in seen:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(key)
                    if len(half):
                        tokens.append(half)
                        owners.append(key)
                        held += len(half)
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DEALT, strict=True)], schema=_DEALT)
            if held >= flush:
                yield packed()
                tokens, owners, held = [], [], 0
        if held:
            yield packed()

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("n_half", pa.int64()), ("rest", pa.list_(pa.int64())), ("token", pa.int64()), ("df", pa.int64())])
_FOUND_SQL = "doc_id long, set_id long, n long, n_half long, rest array<long>, token long, df long"


def _of_tokens(sets: np.ndarray | None, token: np.ndarray, df: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(token), 100_000):
        at = slice(a, a + 100_000)
        size = len(token[at])
        column = lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(x[at])  # noqa: B023, E731
        none = pa.nulls(size, pa.int64())
        yield pa.RecordBatch.from_arrays([none, column(sets), none, none, pa.nulls(size, pa.list_(pa.int64())), pa.array(token[at]), column(df)], schema=_FOUND)


def _in_buckets(parts: list[tuple[int, bytes, bytes | None, bytes | None]]) -> Iterator[pa.RecordBatch]:
    """Of whole buckets: (token, set, number of sets) of tokens that two sets or more have.

    Of hot tokens, (token, null, number) and, for sets that didn't meet them where they are hot, (token, set, null).
    """
    whole = lambda b, low: np.frombuffer(low, dtype=np.uint32).astype(np.int64) | (b << 32)
    cold = [(whole(b, t), np.frombuffer(s, dtype=np.int64)) for b, t, s, _ in parts if s is not None]
    marks = [(whole(b, t), np.frombuffer(c, dtype=np.int64)) for b, t, _, c in parts if c is not None]
    token, sets = (np.concatenate([x[k] for x in cold]) if cold else np.zeros(0, dtype=np.int64) for k in (0, 1))
    order = np.lexsort((sets, token))
    token, sets = token[order], sets[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (sets[1:] != sets[:-1])][: len(token)]
    token, sets = token[new], sets[new]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
    count = np.diff(np.r_[start, len(token)])
    df = np.repeat(count, count)
    if marks:
        name, back = np.unique(np.concatenate([m[0] for m in marks]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([m[1] for m in marks])).astype(np.int64)
        at = np.minimum(np.searchsorted(name, token), len(name) - 1)
        hot = name[at] == token
        np.add.at(total, at[hot], 1)
        yield from _of_tokens(None, name, total)
        yield from _of_tokens(sets[hot], token[hot], None)
        token, sets, df = token[~hot], sets[~hot], df[~hot]
    many = df > 1
    yield from _of_tokens(sets[many], token[many], df[many].astype(np.int64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the buckets of a partition, which come in order, have found; document rows and hot pairs pass through."""
    parts: list[tuple[int, bytes, bytes | None, bytes | None]] = []
    held, last = 0, None
    for batch in batches:
        kind = batch.column("bucket")
        if rows := batch.filter(pc.equal(kind, _DOCUMENT)):
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in list(_FOUND)[:5]), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], schema=_FOUND)
        if hot := batch.filter(pc.equal(kind, _HOT_PAIRS)):
            token, sets = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in hot.column(c).to_pylist()]) for c in ("tokens", "sets"))
            yield from _of_tokens(sets, token, None)
        rest = batch.filter(pc.greater_equal(kind, 0))
        for row in zip(*(rest.column(c).to_pylist() for c in ("bucket", "tokens", "sets", "counts")), strict=True):
            if row[0] != last and held >= _AT_ONCE:
                yield from _in_buckets(parts)
                parts, held = [], 0
            parts.append(row)
            held += len(row[1]) // 4
            last = row[0]
    if parts:
        yield from _in_buckets(parts)


def _sets_of(n: int):
    """The token set of each candidate document's text, if it still is the set that was asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            text, label, key, size = (batch.column(c) for c in ("text", "label", "set_id", "size"))
            found = [(label[i].as_py(), k, size[i].as_py(), s.tobytes()) for i, k in enumerate(key.to_pylist()) if len(s := shingle_set(text[i].as_py(), n, hashes)) and set_id(s) == k]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["label", "set_id", "size", "tokens"])

    return run


def _link_units(num: int, den: int):
    """Links of each unit (rows of one unit follow each other): an edge from each set to the first of its class."""

    def solve(rows: list[tuple[int, bytes, int]]) -> list[tuple[int, int]]:
        known = {k: (s, g) for k, s, g in rows}  # a set may come twice, from documents with the same id
        keys = sorted(known)
        label = linked([np.frombuffer(known[k][0], dtype=np.uint64) for k in keys], num, den, np.unique([known[k][1] for k in keys], return_inverse=True)[1])
        first: dict[int, int] = {}
        return [(k, first.setdefault(int(c), k)) for k, c in zip(keys, label, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = None, []
        out: list[tuple[int, int]] = []
        for pdf in batches:
            for unit, key, tokens, group in zip(pdf["unit"], pdf["set_id"], pdf["tokens"], pdf["class"], strict=True):
                if unit != at:
                    out += solve(rows) if len(rows) > 1 else []
                    at, rows = unit, []
                rows.append((key, tokens, group))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        out += solve(rows) if len(rows) > 1 else []
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _links(units: DataFrame, num: int, den: int) -> DataFrame:
    dealt = units.select("unit", "set_id", "tokens", "class").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInPandas(tidied(_link_units(num, den)), "a long, b long").where("a <> b")


def _pairs(members: DataFrame, block: int) -> DataFrame:
    """``members`` (label, set_id, size, class, main, stay, others) dealt to units of two blocks at most.

    Sets outside their group's main class (which has ``stay`` sets) are dealt in blocks of their own, and so are the main class's. A unit is a pair of the
    former, or one of each: two sets of the main class needn't meet.
    """
    number = lambda n: F.ceil(n / F.lit(block)).cast("long")
    counted = members.withColumn("roams", number(F.col("size") - F.col("stay"))).withColumn("stays", number(F.col("stay"))).where("roams > 0")
    own = lambda n: F.pmod(F.xxhash64(F.lit("pair"), "set_id"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other")
    roam = counted.where("class <> main").withColumn("own", own(F.col("roams")))
    stay = counted.where("class = main").withColumn("own", own(F.col("stays")))
    among = roam.select("*", each(F.col("roams"))).withColumn("unit", F.concat_ws(":", "label", F.lit("r"), F.least("own", "other"), F.greatest("own", "other")))
    here = roam.select("*", each(F.col("stays"))).withColumn("unit", F.concat_ws(":", "label", F.lit("s"), "own", "other"))
    there = stay.select("*", each(F.col("roams"))).withColumn("unit", F.concat_ws(":", "label", F.lit("s"), "other", "own"))
    return among.unionByName(here).unionByName(there)


def ngram_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, block: int = 1024, anchors: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, class_id) for every row of ``docs`` (doc_id, text; others are ignored).

    Two documents link when intersection/union of their n-gram sets is at least num/den (whole numbers, so
    that a pair exactly at the threshold links). component_id is the smallest doc_id that links lead to. class_id names the component by
    one of its sets: components have different ones even where rows with the same doc_id make their smallest doc_ids the same.
    Texts that are null or without a word have size 0 and link with nothing. Rows with a null doc_id are
    returned with their size, a null component and no links. Repeated rows each come back. An
    empty table gives an empty result. Texts are taken whole: the set of one text is in memory at a time.

    ``block`` sets a measure for the sets of a candidate group that one task compares at a time; it changes the work, not
    the result. A larger group is dealt out by hash in blocks of about that many, to each of which the group's ``anchors`` first
    sets are added, so that one large class shows in the first pass. The second pass pairs blocks (see _pairs), so a task
    holds two of them.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(size, 1) / _BUCKET_BYTES)), _BITS[0]), _BITS[1])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / _PART_BYTES))
    dealt = plain.mapInArrow(tidied(_deal(n, num, den, bits)), _DEALT_SQL).repartition(parts, "spread").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(tidied(_shared), _FOUND_SQL), "tokens")
    info = found.where("token is null").select("doc_id", "set_id", "n", "n_half", "rest")
    shared = found.where("token is not null and set_id is not null and df is not null").select("set_id", "token", "df")
    # A set may have met a hot token in several tasks.
    hot = found.where("token is not null and set_id is not null and df is null").select("set_id", "token").distinct()
    counts = found.where("token is not null and set_id is null").select("token", "df")

    # Sets whose prefix isn't all their own tokens.
    sets = info.where("doc_id is not null and set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("n_half").alias("n_half"), F.first("rest").alias("rest"))
    counted = shared.select("set_id").unionByName(hot.select("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_shared"))
    prefix = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")
    left = sets.join(counted, "set_id", "left").withColumn("open", prefix - (F.col("n_half") - F.coalesce("n_shared", F.lit(0)))).where("open > 0")
    left = stored(left.select("set_id", "doc_id", "open", "rest"), "candidates")

    by_set = Window.partitionBy("set_id").orderBy("df", "token")
    wanted = left.select("set_id", "open")
    of_hot = hot.join(wanted, "set_id").join(counts, "token").select("set_id", "token", "df", "open")
    ranked = shared.join(wanted, "set_id").unionByName(of_hot).withColumn("place", F.row_number().over(by_set)).where("place <= open")
    keys = ranked.select(F.col("token").alias("key"), "set_id").unionByName(left.select(F.explode("rest").alias("key"), "set_id"))
    keys = stored(keys, "keys")
    groups = keys.groupBy("key").agg(F.min("set_id").alias("first"), F.max("set_id").alias("last")).where("first <> last").select("key", "first")
    edges = keys.join(dealt_anew(groups, "key"), "key").where("set_id <> first").select(F.col("set_id").alias("a"), F.col("first").alias("b")).distinct()
    labels = connected_components(edges).select(F.col("node").alias("set_id"), F.col("component").alias("label"))

    sized = labels.join(dealt_anew(labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label"), "label")
    wanted = left.select("set_id", "doc_id").join(sized, "set_id")
    texts = plain.join(wanted, "doc_id")
    members = stored(texts.select("text", "label", "set_id", "size").mapInArrow(tidied(_sets_of(n)), "label long, set_id long, size long, tokens binary"), "members")

    n_blocks = F.ceil(F.col("size") / F.lit(block)).cast("long")
    members = members.withColumn("blocks", n_blocks).withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("set_id"), F.col("blocks"))).otherwise(F.lit(0).cast("long")))
    unit = F.concat_ws(":", "label", "block")
    first = members.withColumn("class", F.col("set_id"))
    in_small = first.where("blocks = 1").withColumn("unit", unit)
    large = first.where("blocks > 1")
    ends = large.groupBy("label").agg(F.expr(f"array_sort(slice(array_sort(collect_set(if(block = 0, set_id, null))), 1, {anchors}))").alias("ends")).select("label", F.explode("ends").alias("set_id")).withColumn("anchor", F.lit(True))
    everywhere = large.join(ends, ["label", "set_id"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("anchor")
    in_large = large.join(ends, ["label", "set_id"], "left_anti").unionByName(everywhere.select(*large.columns)).withColumn("unit", unit)
    links = stored(_links(in_small.unionByName(in_large), num, den), "links")

    many = large.select("label").limit(1).count() > 0
    if many:
        classes = large.select("label", "set_id").join(connected_components(links).select(F.col("node").alias("set_id"), F.col("component").alias("class")), "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
        most = classes.groupBy("label", "class").agg(F.count(F.lit(1)).alias("held")).groupBy("label").agg(F.max_by("class", F.struct("held", "class")).alias("main"), F.max("held").alias("stay"))
        classes = stored(classes.join(dealt_anew(most, "label"), "label"), "classes")
        second = _pairs(large.drop("class").join(classes, ["label", "set_id"]), block)
        links = links.unionByName(stored(_links(second, num, den), "links"))

    joined = connected_components(links).select(F.col("node").alias("set_id"), F.col("component").alias("class"))
    by_class = sets.select("set_id", "doc_id").join(joined, "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
    least = by_class.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    result = by_class.join(dealt_anew(least, "class"), "class").select("set_id", "component_id", F.col("class").alias("class_id"))
    rows = info.select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    return rows.join(result, "set_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "set_id", "class_id",
    )


def _set_of(n: int):
    """A function of a text column: the fingerprint of its token set, null where there is none."""

    @F.pandas_udf("long")
    def run(text: pd.Series) -> pd.Series:
        hashes = _WordHashes()
        sets = [shingle_set(t, n, hashes) for t in text]
        return pd.Series([set_id(x) if len(x) else None for x in sets], dtype="Int64")

    return run


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but the first document of each component; columns stay, others than doc_id and text may hold anything.

    Rows without a doc_id can't be told apart and stay. Rows that share a doc_id are judged text by text: of each component whose first document has that id
    one row stays, so that unlinked texts under one id all do. Of rows alike in id and word set, and of rows alike in id and text without a word (null
    and empty are different texts), the one with the least text stays, of equal ones the one with the least hash of all columns. Texts are taken whole; an
    empty table gives an empty result.
    """
    found = stored(ngram_components(docs, **options).where("doc_id is not null"), "found")
    many = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    drop = found.where("doc_id <> component_id").select("doc_id").unionByName(many).distinct()
    kept = docs.where("doc_id is not null").join(drop, "doc_id", "left_anti").select(*docs.columns)

    # Repeated ids: the set of each row's text tells which row is meant. Rows are packed, whatever their columns are called.
    first = found.where("doc_id = component_id and set_id is not null").join(many, "doc_id", "left_semi").groupBy("doc_id", "class_id").agg(F.min("set_id").alias("set")).select(F.col("doc_id").alias("id"), "set")
    rows = docs.join(many, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    named = stored(rows.withColumn("set", _set_of(options.get("n", 5))(F.col("text"))), "repeated-ids")
    again = _one_of(named.where("set is not null").join(first, ["id", "set"], "left_semi"), "set")
    blank = _one_of(named.where("set is null"), "text")
    return kept.unionByName(again).unionByName(blank).unionByName(docs.where("doc_id is null"))


def _one_of(rows: DataFrame, key: str) -> DataFrame:
    """One row of each id and ``key``; combined where rows lie, so that very many alike meet nowhere."""
    return rows.groupBy("id", key).agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row")).select("row.*")

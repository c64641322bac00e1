"""Exact top-k inner products: candidates in buckets by length, pruned by each query's local cosine threshold.

Range partitioning on the norm (ties by a hash of the id, so that copies of one vector spread) deals the candidates
out in buckets of like length; queries go in blocks, also by length. The bucket of the longest vectors, of bounded size, is sent
to all query blocks and gives every query a score to beat. Blocks and buckets meet in tiles, a group of blocks by a group
of buckets, so that a bucket is sent once for many blocks; a bucket group whose longest vector can't beat a block's
least such score isn't met. Within a tile buckets come in order of length, and each raises the scores to beat for the next. In a bucket,
a query whose cosine threshold is high looks only at candidates whose value of its strongest coordinate lies in the feasible
range; the others look at candidates that are long enough. What is left is multiplied out exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import stored

#: Above this cosine the range of a query's strongest coordinate is narrow enough to be worth a sorted search.
COORDINATE_FROM = 0.8
#: Components of a block at most, whatever the vectors' width: 32 MB as doubles.
_CELLS = 1 << 22
#: Whole components from here on are refused: their squares would leave the range of doubles.
_LIMIT = 1e150


def usable(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, v, norm2) of the vectors that take part; norm2 only orders them.

    Null ids, null vectors and vectors with a null or non-finite component take no part.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    kept = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & F.forall(vector_column, finite))
    named = kept.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return named.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + (c * scale) * (c * scale)))


_BLOCK = "part int, size long, width int, kind string, longest double, ids binary, data binary"


def _packed(rows_at_most: int, scale: float):
    """Rows of a partition as blocks: ids and a matrix of floor(scale * x), longest vector first.

    Whole numbers are kept in the smallest type that holds them all. Doubles hold each of them exactly.
    """

    def block(part: int, ids: list, vectors: list) -> dict:
        width = max((len(v) for v in vectors), default=0)
        data = np.zeros((len(ids), width))
        for row, v in zip(data, vectors, strict=True):
            row[: len(v)] = np.floor(scale * np.asarray(v, dtype=float))
        if data.size and np.abs(data).max() >= _LIMIT:
            raise ValueError(f"a vector has a scaled component of {_LIMIT:g} or more: its products leave 64 bits")
        norms = np.sqrt((data**2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        kind = next((t for t in ("i1", "i2", "i4") if not data.size or np.abs(data).max() <= np.iinfo(t).max), "f8")
        return {"part": part, "size": len(ids), "width": width, "kind": kind, "longest": float(norms.max()), "ids": np.array(ids, dtype=np.int64)[order].tobytes(), "data": data[order].astype(kind).tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, part = [], [], 0
        for pdf in batches:
            for i, v, part in zip(pdf["id"], pdf["v"], pdf["p"], strict=True):
                ids.append(i), vectors.append(v)
                if len(ids) == rows_at_most:
                    yield pd.DataFrame([block(part, ids, vectors)])
                    ids, vectors = [], []
        if ids:
            yield pd.DataFrame([block(part, ids, vectors)])

    return run


def _unpacked(size: int, width: int, kind: str, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(data, dtype=kind).reshape(size, width).astype(float)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        want = k - len(above)
        if len(level) > want:
            level = level[np.argpartition(ids[level], want - 1)[:want]]
        return np.r_[above, level]
    return np.arange(len(ids))


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor_: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(query place, candidate ids, scores) of each query's k best in one bucket, of those that can reach ``floor_``.

    ``q`` and ``c`` hold whole numbers as doubles; ``c`` is in order of length, longest first. ``floor_``: a score for each query that its
    k-th best reaches at least (-inf: none known), so that a candidate below it can be left out; one equal to it can't.
    Products below 2**52 are exact as doubles. Above, doubles choose who may be among the k best, within their error, and those
    are multiplied out as Python's whole numbers.
    """
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    q_len, c_len = (np.sqrt((x**2).sum(axis=1)) for x in (q, c))
    floor_ = np.full(len(q), -np.inf) if floor_ is None else floor_
    top = c_len.max(initial=0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        cosine = np.where(floor_ == -np.inf, -1.0, np.where(q_len * top > 0, floor_ / (q_len * top), np.where(floor_ > 0, 2.0, -1.0)))
        need = np.where((q_len > 0) & (floor_ > 0), floor_ / np.maximum(q_len, 1e-300), 0.0) * (1 - 1e-12)
    reach = len(c) - np.searchsorted(c_len[::-1], need, side="left")

    def chosen(i: int, at: np.ndarray, scores: np.ndarray) -> tuple[int, np.ndarray, list[int]]:
        """The k best of candidates ``at``, whose products as doubles are ``scores``."""
        if q_len[i] * top < 2**52:
            best = _best(c_ids[at], scores, k)
            return i, c_ids[at[best]], [int(x) for x in scores[best]]
        off = (width + 2) * 2.0**-52 * q_len[i] * c_len[at]
        if len(at) > k:
            may = scores + off >= np.partition(scores - off, len(at) - k)[len(at) - k]
            at = at[may]
        exact = [sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True)) for j in at]
        best = sorted(range(len(at)), key=lambda x: (-exact[x], c_ids[at[x]]))[:k]
        return i, c_ids[at[best]], [exact[x] for x in best]

    by_length = np.flatnonzero((cosine <= 1 + 1e-9) & (cosine < COORDINATE_FROM) & (reach > 0))
    for a in range(0, len(by_length), 256):
        part = by_length[a : a + 256]
        products = q[part] @ c[: int(reach[part].max())].T
        for row, i in zip(products, part, strict=True):
            at = np.flatnonzero(c_ids[: reach[i]] != q_ids[i])
            yield chosen(int(i), at, row[at])
    narrow = np.flatnonzero((cosine <= 1 + 1e-9) & (cosine >= COORDINATE_FROM))
    if len(narrow):
        focus = np.abs(q[narrow]).argmax(axis=1)
        unit = c / np.maximum(c_len, 1e-300)[:, None]
        for f in np.unique(focus):
            order = np.argsort(unit[:, f], kind="stable")
            line = unit[order, f]
            for i in narrow[focus == f]:
                x, t = q[i, f] / q_len[i], min(max(float(cosine[i]), -1.0), 1.0)
                # A unit vector within the angle arccos t of the query has its coordinate within that angle of the query's.
                spread = math.acos(t) + 1e-7
                angle = math.acos(max(-1.0, min(1.0, x)))
                low, high = math.cos(min(math.pi, angle + spread)), math.cos(max(0.0, angle - spread))
                a, b = np.searchsorted(line, low - 1e-7, "left"), np.searchsorted(line, high + 1e-7, "right")
                near = order[a:b]
                near = near[(c_ids[near] != q_ids[i]) & (near < reach[i])]
                yield chosen(int(i), near, c[near] @ q[i])


def _seeded(k: int):
    """Query blocks with each query's k-th best score in the seed bucket as its floor (-inf if it has fewer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                q_ids, q = _unpacked(r.size, r.width, r.kind, r.ids, r.data)
                c_ids, c = _unpacked(r.s_size, r.s_width, r.s_kind, r.s_ids, r.s_data)
                floors = np.full(len(q_ids), -np.inf)
                for i, _, scores in search(q_ids, q, c_ids, c, k, None):
                    if len(scores) >= k:
                        floors[i] = np.nextafter(float(min(scores)), -np.inf)  # a large score may be rounded up
                rows.append(floors)
            kept = pdf[["part", "size", "width", "kind", "longest", "ids", "data"]]
            yield kept.assign(floors=[f.tobytes() for f in rows], least=[float(f.min(initial=np.inf)) for f in rows])

    return run


_FOUND = "query_id long, vec_id long, score long, over boolean"


def _tile(k: int):
    """The k best of each query of a tile's blocks in the tile's buckets, of those that reach its floor."""

    def run(blocks: pd.DataFrame, buckets: pd.DataFrame) -> pd.DataFrame:
        out = []
        buckets = [(r.longest, *_unpacked(r.size, r.width, r.kind, r.ids, r.data)) for r in buckets.sort_values("longest", ascending=False).itertuples(index=False)]
        for r in blocks.itertuples(index=False):
            q_ids, q = _unpacked(r.size, r.width, r.kind, r.ids, r.data)
            floors = np.frombuffer(r.floors, dtype=float).copy()
            best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
            for longest, c_ids, c in buckets:
                if r.longest * longest * (1 + 1e-9) < floors.min(initial=np.inf):
                    continue
                for i, ids, scores in search(q_ids, q, c_ids, c, k, floors):
                    best[i] = sorted([*best[i], *((-s, int(v)) for v, s in zip(ids, scores, strict=True) if s >= floors[i])])[:k]
                    if len(best[i]) == k:
                        floors[i] = max(floors[i], np.nextafter(float(-best[i][-1][0]), -np.inf))
            for i, found in enumerate(best):
                # Scores outside 64 bits are an error, unless enough others are higher.
                out += [(q_ids[i], v, max(min(-s, 2**63 - 1), -(2**63)), not -(2**63) <= -s < 2**63) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "over"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding", bucket: int = 8192, block: int = 512, tile: tuple[int, int] = (32, 8)) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors but its own.

    Both frames have the id and vector columns; others are ignored, whatever their names. Components are floor(scale * x). Scores that tie
    go to the smaller id, so ranks are fixed; a query with fewer candidates has them all. A candidate with the query's id is the query's own,
    so of rows that repeat an id none is another's candidate; each of them is a candidate of other queries. Null ids and vectors, and
    vectors with a null or non-finite component take no part. Vectors of differing lengths count as padded with zeros, very long ones make
    smaller blocks. An empty frame gives an empty result. Scores are exact whole numbers: a score among the k best that leaves 64 bits is an
    error, and so is a scaled component of 1e150 or more.

    ``bucket`` and ``block`` bound the vectors that are multiplied at a time, ``tile`` the blocks and buckets that meet in one group.
    """

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        rows = usable(df, id_column, vector_column, scale)
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        size = max(1, min(size, _CELLS // max(width or 1, 1)))
        parts = max(1, math.ceil(n / size))
        dealt = rows.repartitionByRange(parts, F.col("norm2").desc(), F.xxhash64("id")).withColumn("p", F.spark_partition_id())
        return stored(dealt.mapInPandas(_packed(size, scale), _BLOCK), name), parts

    buckets, n_buckets = blocks(vectors, bucket, "buckets")
    asked, n_blocks = blocks(queries, block, "queries")
    # Small tables are cut finer, for enough tiles to keep a cluster busy.
    most = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    a = max(1, min(tile[0], n_blocks // math.isqrt(2 * most) or 1))
    b = max(1, min(tile[1], n_buckets // math.isqrt(2 * most) or 1))
    buckets, asked = (df.withColumn(g, F.floor(F.col("part") / n).cast("int")) for df, g, n in ((buckets, "there", b), (asked, "here", a)))

    seed = buckets.orderBy(F.col("longest").desc(), "part").limit(1).select(*(F.col(c).alias(f"s_{c}") for c in ("size", "width", "kind", "ids", "data")))
    plain = "part int, size long, width int, kind string, longest double, ids binary, data binary"
    floors = stored(asked.drop("here").crossJoin(F.broadcast(seed)).mapInPandas(_seeded(k), f"{plain}, floors binary, least double"), "floors").withColumn("here", F.floor(F.col("part") / a).cast("int"))

    # One number a bucket group says how far down in length a block must look.
    lengths = buckets.groupBy("there").agg(F.max("longest").alias("longest")).agg(F.collect_list(F.struct("there", "longest")).alias("lengths"))
    may = lambda x: (F.col("least") == float("-inf")) | (F.col("longest") * x["longest"] * (1 + 1e-9) >= F.col("least"))
    met = F.transform(F.filter("lengths", may), lambda x: x["there"])
    asked = floors.crossJoin(F.broadcast(lengths)).withColumn("there", F.explode(met)).drop("lengths", "least")
    pairs = asked.select(F.col("here").alias("from"), F.col("there").alias("to")).distinct()
    tiles = asked.groupBy("here", "there").cogroup(buckets.join(pairs, F.col("there") == F.col("to")).groupBy("from", "to"))
    found = tiles.applyInPandas(_tile(k), _FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    exact = F.when(F.col("over"), F.raise_error(F.lit("a score leaves 64 bits"))).otherwise(F.col("score"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", exact.cast("long").alias("score"))

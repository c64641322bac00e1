"""Merkle manifest of a table: a digest of every row, a tree of them for each group, a tree of the groups' roots, and a proof for every row.

The leaves are put in order by range partitions and numbered from counts of those. Trees are built in blocks of ``2 ** _LEVELS`` neighbours, block roots
in blocks again. Proofs come from pointer jumping: at first each node holds its own sibling, the segment of the path to its parent. Each self-join
doubles the distance, as the node's segment is followed by that of the node it has reached; only nodes on levels that a later join asks
for are kept. After log2(depth) joins each leaf's segment reaches the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import stored

#: Levels that one pass builds: a block has 256 nodes at most.
_LEVELS = 8
_NODES = "tree long, size long, level int, place long, sibling binary, top binary"


def field(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 length in bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 of a row's values, as binary."""
    return F.unhex(F.sha2(F.concat(*(field(v) for v in values)), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, group: str | None, order: Sequence[str]) -> DataFrame:
    """``rows`` with tree, place and size: a number of each ``group``, the row's place in it by ``order`` (from 0), and the group's rows.

    Without a group all rows are one. A group of any size lies in as many range partitions as it takes, rows that tie in ``order`` as well; what is added up are
    rows by (partition, group) only.
    """
    group_by = [group] if group else []
    ranged = stored(
        rows.repartitionByRange(*group_by, *order, F.rand(12)).sortWithinPartitions(*group_by, *order).withColumn("__row", F.monotonically_increasing_id()), "ranged"
    )
    part = F.shiftright("__row", 33).alias("__part")
    parts = ranged.groupBy(*group_by, part).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # Without a group there is a row for each partition; with one, rows of it lie in as many tasks as it has rows here.
    all_ = Window.partitionBy(*(group_by or [F.lit(0)]))
    before = F.sum("__n").over(all_.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    parts = stored(parts.select("*", before.alias("__before"), F.sum("__n").over(all_).alias("size"), F.min("__first").over(all_).alias("tree")), "parts")
    same = F.col("l.__part") == F.col("r.__part")
    if group:
        same = same & F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}"))
    joined = ranged.select("*", part).alias("l").join(parts.alias("r"), same)
    return joined.select(*(F.col(f"l.{c}") for c in rows.columns), "r.tree", (F.col("l.__row") - F.col("r.__first") + F.col("r.__before")).alias("place"), "r.size")


def _sha(parts: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def _grown(level: int):
    """From nodes of ``level`` in order, blocks one after the other: all nodes of the block with their siblings, and what remains of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, nodes = [], None, []

        def close() -> None:
            tree, size, number = block
            now, first, left = level, number << _LEVELS, nodes
            while now < min((size - 1).bit_length(), level + _LEVELS):
                out.extend((tree, size, now, first + k, left[k ^ 1] if k ^ 1 < len(left) else None, None) for k in range(len(left)))
                left = [_sha(left[k : k + 2]) for k in range(0, len(left), 2)]
                now, first = now + 1, first >> 1
            out.append((tree, size, now, first, None, left[0]))

        def sent() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "size", "level", "place", "sibling", "top"])
            out.clear()
            return batch

        for batch in batches:
            for tree, size, place, top in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "place", "top")), strict=True):
                if block != (tree, size, place >> _LEVELS):
                    if block:
                        close()
                    block, nodes = (tree, size, place >> _LEVELS), []
                nodes.append(top)
            if len(out) > 20_000:
                yield sent()
        if block:
            close()
            yield sent()

    return run


def _depth(size: Column) -> Column:
    """Levels above the leaves; whole numbers only, as a logarithm may miss a power of two."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (tree, level, place, sibling) of all levels below the roots, the roots (tree, root), and the greatest depth."""
    depth = leaves.agg(F.max(_depth(F.col("size")))).first()[0] or 0
    roots = leaves.where("size = 1").select("tree", F.col("leaf").alias("root"))
    now, level, nodes = leaves.where("size > 1").select("tree", "size", "place", F.col("leaf").alias("top")), 0, None
    while level < max(depth, 1):
        dealt = now.repartition("tree", F.shiftright("place", _LEVELS)).sortWithinPartitions("tree", "place")
        grown = stored(dealt.mapInArrow(_grown(level), _NODES), "nodes")
        below = grown.where("top IS NULL").select("tree", "level", "place", "sibling")
        nodes = below if nodes is None else nodes.unionByName(below)
        level += _LEVELS
        ended = _depth(F.col("size")) <= level
        tops = grown.where("top IS NOT NULL")
        roots = roots.unionByName(tops.where(ended).select("tree", F.col("top").alias("root")))
        now = tops.where(~ended).select("tree", "size", "place", "top")
    return nodes, roots, depth


def _paths(leaves: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``leaves`` with ``path``: the siblings on each level from the leaf to its tree's root, null where there is none."""
    payload = [c for c in leaves.columns if c not in ("tree", "place")]
    none = F.array().cast("array<binary>")
    own = F.when(F.col("size") > 1, F.array("sibling")).otherwise(none)
    first = leaves.join(nodes.where("level = 0").drop("level"), ["tree", "place"], "left").select("tree", "place", *payload, F.lit(0).alias("level"), own.alias("path"))
    above = nodes.where("level > 0").select("tree", "place", *(F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in payload), "level", F.array("sibling").alias("path"))
    now, step = first.unionByName(above), 1
    while step < depth:
        now = stored(now, f"jump-{step}")
        level = F.col("level") % (2 * step)
        reached = now.where(level == step).select("tree", (F.col("level") - step).alias("level"), F.col("place").alias("__up"), F.col("path").alias("__more"))
        # There are 2 ** step times fewer nodes that are reached: by themselves, so that their size is known where the join is planned.
        reached = stored(reached, f"reached-{step}")
        asked = now.where(level == 0).withColumn("__up", F.shiftright("place", step))
        more = F.concat("path", F.coalesce("__more", none)).alias("path")
        now = asked.join(reached, ["tree", "level", "__up"], "left").select("tree", "place", *payload, "level", more)
        step *= 2
    return now.where("level = 0").drop("level")


def folded(start: Column, place: Column, path: Column) -> Column:
    """The root that a digest (lower-case hex) at ``place`` leads to by its ``path`` of siblings."""
    steps = F.transform(path, lambda s, k: F.struct(_hex(s).alias("s"), (F.call_function("getbit", place, k) == 1).alias("right")))
    pair = lambda acc, x: F.when(x["s"].isNull(), acc).when(x["right"], F.concat(x["s"], acc)).otherwise(F.concat(acc, x["s"]))
    return F.aggregate(steps, start, lambda acc, x: F.sha2(pair(acc, x), 256))


def manifest(rows: DataFrame, columns: Sequence[str], group: str, order: str, also: dict[str, Column] | None = None) -> DataFrame:
    """A row for each of ``rows``: its ``order`` value, ``also``'s columns, and its place in the manifest.

    leaf (digest of ``columns``, binary), place (in its group, from 0), size (of the group), path (siblings, level by level, null where a node stands
    alone), subroot, and group_place, group_path, root of the groups' own tree. Digests are binary.

    Leaves stand by ``order`` (null first), of one value by their digests; groups by their values (null first, by bytes). Rows that are alike in everything
    have places of their own. A lone leaf is its group's subroot, a lone group's subroot the root. Nulls in any column count as ``-``; texts are
    hashed whole. An empty table has no rows and no root. Columns that aren't named are not read, whatever their names.
    """
    also = also or {}
    if {order, *also} & {"leaf", "tree", "place", "size", "path", "subroot", "group_place", "group_path", "root", "__group"}:
        raise ValueError("a column has the name of one of the manifest's")
    leaves = rows.select(F.col(order), F.col(group).cast("string").alias("__group"), leaf([F.col(c) for c in columns]).alias("leaf"), *(c.alias(k) for k, c in also.items()))
    leaves = stored(numbered(stored(leaves, "leaves"), "__group", [order, "leaf"]), "leaves")
    nodes, roots, depth = _trees(leaves)
    groups = leaves.where("place = 0").select("tree", "__group").join(roots, "tree").select(F.col("tree").alias("__tree"), "__group", F.col("root").alias("leaf"))
    groups = stored(numbered(stored(groups, "groups"), None, ["__group"]), "groups")
    above, top, high = _trees(groups)
    group_paths = _paths(groups, above, high).join(top, "tree").select(
        F.col("__tree").alias("tree"), F.col("leaf").alias("subroot"), F.col("place").alias("group_place"), F.col("path").alias("group_path"), "root"
    )
    found = _paths(leaves.drop("__group"), nodes, depth).join(stored(group_paths, "group-paths"), "tree")
    return found.select(order, *also, "leaf", "place", "size", "path", "subroot", "group_place", "group_path", "root")


def refolded(start: str = "leaf") -> Column:
    """On a manifest: the root (lower-case hex) that the digests of column ``start`` lead to by each row's proof."""
    return folded(folded(_hex(F.col(start)), F.col("place"), F.col("path")), F.col("group_place"), F.col("group_path"))


def proof() -> Column:
    """On a manifest: a row's siblings up to the root, lower-case hex, where there are any."""
    return F.transform(F.filter(F.concat("path", "group_path"), lambda s: s.isNotNull()), _hex)

"""Spelling variants: words one letter apart, found by a dictionary of trie-node pairs, and the form that each word is a variant of.

Words are cut at every place. What stands before the place is a node of a trie of the words, what stands behind it one of a trie of the words read
backwards, so a cut word is a pair of whole numbers. Without the letter behind the place it is another pair: words that share such a
pair differ in that letter only; a word whose own pair it is has the letter less. Pairs are exact, so nothing is compared letter by letter.

Nodes are numbered where the words lie sorted: a node is new where a word leaves the one before it. Nodes that range partitions share are those on
the paths to their bounds; they get numbers beforehand, from two words a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import stored

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Numbers of new nodes (and of words) in a partition start at its own multiple of this.
_ROOM = 1 << 40


def runs(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., word): every run of letters of every whole text, only A-Z made lower; null has none."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    return docs.select(*keep, F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("word"))


def vocabulary(found: DataFrame, least: int = 3, letters: int = 5) -> DataFrame:
    """(word, n): words of at least ``letters`` code points that ``found`` holds at least ``least`` times. Nulls are no words."""
    return found.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _shared(a: str, b: str) -> int:
    """Letters that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def _bounds(ends: list[tuple[int, str, str]]) -> dict[int, tuple[tuple[str, list[int]], tuple[str, list[int]]]]:
    """For each partition the beginnings it shares with the one before and the one behind, and the numbers (below 0) of the nodes on them."""
    none = ("", [0])
    between, new = [none], 0
    for (_, _, last), (_, first, _) in zip(ends, ends[1:]):
        shared = first[: _shared(last, first)]
        known = _shared(between[-1][0], shared)
        between.append((shared, between[-1][1][: known + 1] + [new - k for k in range(1, len(shared) - known + 1)]))
        new -= len(shared) - known
    between.append(none)
    return {part: (between[k], between[k + 1]) for k, (part, _, _) in enumerate(ends)}


def with_nodes(words: DataFrame, key: Column, column: str, place: str | None = None) -> DataFrame:
    """``words`` with ``column``: the numbers of the trie nodes on the way from the root (0) to each word's ``key``, one more than it has letters.

    ``place``, if named, is a number by which the keys are in code-point order. Keys must be distinct and not null.
    """
    ranged = stored(words.withColumn("__key", key).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("__part").agg(F.min("__key"), F.max("__key")).orderBy("__part").collect()
    bounds = words.sparkSession.sparkContext.broadcast(_bounds([tuple(r) for r in ends]))  # two words a partition
    kept = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path, new, n = None, "", [0], 0, 0
        for batch in batches:
            paths, places = [], []
            for p, word in zip(batch.column("__part").to_pylist(), batch.column("__key").to_pylist(), strict=True):
                if p != part:
                    part, before, path = p, "", [0]
                    new = n = (p + 1) * _ROOM
                    (left, left_nodes), (right, right_nodes) = bounds.value[p]
                same = _shared(before, word)
                path = path[: same + 1]
                if same < len(word):
                    on_left, on_right = _shared(left, word), _shared(right, word)
                    path += left_nodes[same + 1 : on_left + 1]
                    path += right_nodes[len(path) : on_right + 1]
                    path += range(new, new + len(word) + 1 - len(path))
                    new += len(word)
                before = word
                paths.append(path)
                places.append(n)
                n += 1
            columns = [*(batch.column(c) for c in kept), pa.array(paths, pa.list_(pa.int64()))] + [pa.array(places, pa.int64())] * bool(place)
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, column, *([place] if place else [])])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields] + [f"`{column}` array<bigint>"] + [f"`{place}` bigint"] * bool(place))
    return ranged.repartition("__part").sortWithinPartitions("__part", "__key").mapInArrow(run, schema)


def _pairs(words: DataFrame) -> DataFrame:
    """(a, b, kind, n, place) of ``words`` (n, place, fore, back): kind 0 the whole word cut before a letter or at its end, 1 without the letter behind
    the cut, 2 the same where the letter before is alike: taking that one instead has given the same word already."""
    size = F.size("fore") - 1
    cut = words.select("n", "place", "back", "alike", size.alias("size"), F.posexplode("fore").alias("i", "a"))
    rest = lambda k: F.try_element_at("back", F.col("size") - F.col("i") + 1 - k)
    skipped = F.when(F.col("i") < F.col("size"), F.struct(rest(1).alias("b"), F.when(F.try_element_at("alike", F.col("i") + 1), 2).otherwise(1).alias("kind")))
    both = F.array(F.struct(rest(0).alias("b"), F.lit(0).alias("kind")), skipped)
    return cut.select("n", "place", "a", F.explode(both).alias("x")).where("x IS NOT NULL").select("a", "x.b", "x.kind", "n", "place")


def neighbours(words: DataFrame) -> DataFrame:
    """(place, n_near, best) of ``words`` (n, place, fore, back, alike) with a near word: how many there are, and of them (n, -place) of the most frequent, of equals the first.

    A pair of nodes has as many words without a letter as there are letters for its gap, and one whole word: groups are small however many words there are.
    No two words are seen as near in more than one group.
    """
    rank = lambda x: F.struct(x["n"].alias("n"), (-x["place"]).alias("back"))
    grouped = _pairs(words).groupBy("a", "b").agg(F.collect_list(F.struct("kind", "n", "place")).alias("m")).where("size(m) > 1 AND exists(m, x -> x.kind > 0)")
    gap = F.array_sort(F.transform(F.filter("m", lambda x: x["kind"] > 0), lambda x: F.struct((-x["n"]).alias("n"), x["place"].alias("place"), x["kind"].alias("kind"))))
    split = grouped.select(F.transform(gap, lambda x: F.struct((-x["n"]).alias("n"), x["place"].alias("place"), x["kind"].alias("kind"))).alias("gap"), F.try_element_at(F.filter("m", lambda x: x["kind"] == 0), F.lit(1)).alias("whole"))

    def of_gap(x: Column) -> Column:
        other = F.try_element_at("gap", F.when(F.col("gap")[0]["place"] == x["place"], 2).otherwise(1))
        shorter = F.when(x["kind"] == 1, F.col("whole"))
        return F.struct(
            x["place"].alias("place"), (F.size("gap") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("near"),
            F.greatest(F.when(other.isNotNull(), rank(other)), F.when(shorter.isNotNull(), rank(shorter))).alias("best"),
        )

    longer = F.filter("gap", lambda x: x["kind"] == 1)
    of_whole = F.when(F.col("whole").isNotNull(), F.struct(F.col("whole.place").alias("place"), F.size(longer).alias("near"), F.when(F.size(longer) > 0, rank(F.try_element_at(longer, F.lit(1)))).alias("best")))
    seen = split.select(F.explode(F.concat(F.transform("gap", of_gap), F.array(of_whole))).alias("x")).where("x.near > 0").select("x.*")
    return seen.groupBy("place").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def _roots(edges: DataFrame) -> DataFrame:
    """(place, root) of ``edges`` (place, form_place): the last form, by pointers that reach twice as far each round."""
    now = stored(edges.select("place", F.col("form_place").alias("root")), "roots")
    while True:
        further = now.alias("x").join(now.alias("y"), F.col("x.root") == F.col("y.place"), "left")
        again = stored(further.select("x.place", F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved")), "roots")
        now = again.drop("moved")
        if not again.where("moved").head(1):
            return now


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word: distinct; n): one row each.

    Near words differ by one inserted, deleted or replaced code point. The form is the near word of the largest n, of equals the first in code-point
    order, if its n is twice the word's at least. root follows forms to the last; a word without a form is its own. n_near counts near words.

    Null words are left out; the empty word has neighbours of one letter. Words of any length take room in proportion to it. An empty table gives an empty
    result; columns beside word and n are not read.
    """
    plain = words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    fore = with_nodes(plain, F.col("word"), "fore", "place")
    both = stored(with_nodes(fore, F.reverse("word"), "back"), "trie-paths")
    letters = F.split("word", "")
    alike = F.zip_with(letters, F.concat(F.array(F.lit("")), F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0)))), lambda x, y: x == y)
    near = neighbours(both.select("n", "place", "fore", "back", alike.alias("alike")))
    form = F.when(F.col("best.n") >= 2 * F.col("n"), -F.col("best.back"))
    names = both.select("word", "n", "place")
    known = stored(names.join(near, "place", "left").select("place", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form_place")), "forms")
    roots = _roots(known.where("form_place IS NOT NULL").select("place", "form_place"))
    forms = known.select(F.col("place").alias("form_place"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    lasts = known.select(F.col("place").alias("root"), F.col("word").alias("root_word"))
    changed = known.where("form_place IS NOT NULL").join(roots, "place").join(forms, "form_place").join(lasts, "root").select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    none = F.lit(None)
    own = known.where("form_place IS NULL").select("word", none.cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", none.cast("long").alias("form_n"))
    return changed.unionByName(own)

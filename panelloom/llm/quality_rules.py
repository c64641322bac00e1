"""Quality rules: a threshold table compiled into one projection, without user functions or a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import SPACE, let, words

#: Frequent function words of the languages that the corpus holds.
STOP_WORDS = {
    "en": "the of and to in is a that it for on as with was at by be this from or are an which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un une du que est dans qui par pour au sur ne se pas",
    "es": "de la que el en y a los del se las por un para con no una su al lo como",
}


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` is wanted of texts of at least ``from_words`` words."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    #: Only for texts of which at least half of the words' characters are Latin letters.
    latin: bool = False


#: The first two rules are the base; the others only catch what no ordinary prose comes near. The last one knows the function words of four
#: languages: texts in other scripts are exempt from it, and for corpora in other languages of Latin script it's to be left out, or given their words.
RULES = (
    Rule("n_words", low=10),
    Rule("repeat_ratio", high=0.20),
    Rule("mean_word_chars", low=2.0, high=14.0, from_words=10),
    Rule("symbol_ratio", high=0.30, from_words=10),
    Rule("dup_line_ratio", high=0.60, from_words=30),
    Rule("stop_word_ratio", low=0.01, from_words=150, latin=True),
)
BASE = 2
_WINDOW = 5


def _repeated_words(w: Column) -> Column:
    """Words in windows of five that the text holds twice or more.

    If no two windows have the same hash, no two are alike. Else they are compared as
    strings: words hold no space, so joining with one is one-to-one. Sorted (window, place) pairs put
    equal windows side by side, and each place found adds what its window covers beyond the one before.
    """

    def of(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i, step: F.coalesce(F.get(s, i + step)["g"] == x["g"], F.lit(False))
            return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["i"])), lambda p: p.isNotNull()))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-_WINDOW).cast("int").alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(_WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        covered = lambda p: F.aggregate(p, start, step, lambda acc: acc["n"])
        return let(let(pairs, places), covered)

    n = F.size(w)
    windows = F.arrays_zip(*(F.slice(w, k + 1, n - (_WINDOW - 1)).alias(f"w{k}") for k in range(_WINDOW)))
    hashes = F.transform(windows, lambda x: F.xxhash64(x))
    grams = F.transform(windows, lambda x: F.concat_ws(" ", *(x[f"w{k}"] for k in range(_WINDOW))))
    no_two_alike = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((n <= _WINDOW) | no_two_alike, F.lit(0).cast("long")).otherwise(let(grams, of))


def _counts(text: Column) -> Column:
    """All counts of one text, as a struct; words and lines are split once."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({x for v in STOP_WORDS.values() for x in v.split()})

    def of(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                _repeated_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
            ),
        )

    return let(words(text), of)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def compiled(c: Column, rules: tuple[Rule, ...], text: Column) -> list[Column]:
    """One Boolean for each rule: does the text, whose counts are ``c``, fail it?"""
    latin = 2 * F.length(F.regexp_replace(text, "[^A-Za-zÀ-ɏ]+", "")) >= c["word_chars"]
    metrics = {
        "n_words": c["n_words"].cast("double"),
        "mean_word_chars": _ratio(c["word_chars"], c["n_words"]),
        "symbol_ratio": _ratio(c["n_symbols"], c["n_words"]),
        "dup_line_ratio": _ratio(c["n_dup_lines"], c["n_lines"]),
        "repeat_ratio": _ratio(c["n_repeat_words"], c["n_words"]),
        "stop_word_ratio": _ratio(c["n_stop_words"], c["n_words"]),
    }
    out = []
    for r in rules:
        m, bad = metrics[r.metric], F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            # Whole numbers where the contract has them: 100 * repeated > 20 * words.
            bad = bad | ((100 * c["n_repeat_words"] > round(100 * r.high) * c["n_words"]) if r.metric == "repeat_ratio" else (m > r.high))
        bad = bad & (c["n_words"] >= r.from_words)
        out.append(F.coalesce(bad & latin, F.lit(False)) if r.latin else bad)
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """``docs`` (any columns, among them text) with a struct ``quality``: counts, failed rules and verdict.

    A null, empty or blank text has no words, fails the base and isn't kept. Rows are judged one
    by one, so repeated rows, ties and empty tables need no rule; other columns pass through, and one named
    quality is replaced. Texts are counted whole, in time n log n of their words.
    """
    counted = docs.withColumn("quality", _counts(F.col("text")))
    c = F.col("quality")
    failed = compiled(c, rules, F.col("text"))
    names = F.array_compact(F.array(*(F.when(bad, F.lit(f"{r.metric}{'' if r.high is None else '<=' + str(r.high)}{'' if r.low is None else '>=' + str(r.low)}")) for r, bad in zip(rules, failed, strict=True))))
    any_of = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
    return counted.withColumn(
        "quality",
        c.withField("failed", names).withField("base_failed", any_of(failed[:base])).withField("kept", ~any_of(failed)),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; columns as before, whatever their names beside text. Else as ``quality``."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row__")
    judged = docs.select(row, "text").withColumn("quality__", _counts(F.col("text")))
    failed = compiled(F.col("quality__"), RULES, F.col("text"))
    return judged.where(~F.greatest(*failed)).select("row__.*")

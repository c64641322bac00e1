"""Mixing to target weights: soft domain membership, and document rates by projected least squares.

A naive Bayes classifier, fitted on a bounded sample of the labelled table, gives each document posteriors over
domains. Rates r_d >= 0, all 1 at first, are moved until the expected token totals sum_d r_d n_d p_dk match the
targets. Each step is one distributed pass that returns K totals and a K x K matrix: the gradient of the
squared error for a document is its posteriors times the K residuals, so the step is sent out as K numbers and
every document projects its own rate onto r >= 0. All on the main path is DataFrame expressions.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import let, sample_ids, stored, words

#: Domains of the labelled table, and the share of tokens that each should have.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.92, "poor": 0.05, "toxic": 0.03}
BUCKETS = 1024
DAMPING = 0.02
#: Shares of a fitting step that are tried beside the whole.
SHORTENED = (0.5, 0.25)
#: A text's words aren't independent: together they count as so many at most. All of them are read, a text of more words has the same
#: mean evidence a word, weighed as if it had this many. Without it posteriors of long texts are all 0 or 1.
EVIDENCE = 60
#: Words that mark a domain alone: so many at most (a bound on the model, as BUCKETS is), in so many sampled texts at least, so many standard
#: deviations from chance.
TELLING_WORDS, TELLING_TEXTS, TELLING = 64, 8, 6.0


@dataclass(frozen=True)
class Classifier:
    """Log prior of each domain (of a text without telling words), and log odds against the mean domain.

    ``weights``: of each word bucket, for the text's make-up; ``telling``: of a word's presence over its absence, for single words that mark a
    domain. Odds add up to 0 over domains, so the last domain's aren't kept.
    """

    prior: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    telling: dict[str, tuple[float, ...]]


def domain(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number) of the labelled rows; rows with a null in any column say nothing.

    Of rows that repeat a doc_id, the worst label counts.
    """
    k = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(k).alias("domain"))


def _bucket(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000) -> Classifier:
    """Naive Bayes on word buckets, from at most ``sample_docs`` labelled documents.

    The sample is the ids with the least hashes, of which each domain gets an equal part, so that a rare one is
    seen. The ids alone are broadcast. What comes to the driver is one count a bucket and domain, and the telling words. Without
    labels all documents get equal posteriors.
    """
    share = sample_docs // len(DOMAINS)
    known = domain(labels)
    parts = [sample_ids(known.where(F.col("domain") == k), "doc_id", share) for k in range(len(DOMAINS))]
    ids = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    split = sample.select("domain", words(F.col("text")).alias("w"))
    seen = split.select("domain", F.explode(F.array_distinct(F.transform("w", _bucket))).alias("bucket"))
    counts = [[0] * len(DOMAINS) for _ in range(BUCKETS)]
    for r in seen.groupBy("bucket", "domain").count().collect():
        counts[r["bucket"]][r["domain"]] = r["count"]
    sampled = [0] * len(DOMAINS)
    for r in sample.groupBy("domain").count().collect():
        sampled[r["domain"]] = r["count"]
    size = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(size.values())
    prior = tuple(math.log((size.get(k, 0) + 1) / (total + len(DOMAINS))) for k in range(len(DOMAINS)))
    sums = [sum(c[k] + 1 for c in counts) for k in range(len(DOMAINS))]
    centred = lambda logs: tuple(round(x - sum(logs) / len(logs), 3) for x in logs[:-1])
    weights = tuple(centred([math.log((x + 1) / t) for x, t in zip(c, sums, strict=True)]) for c in counts)

    # Words far from chance: of those, the farthest.
    each = [F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(len(DOMAINS))]
    by_word = split.select("domain", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *each).where(F.col("n") >= TELLING_TEXTS)
    share = [max(n, 1) / max(sum(sampled), 1) for n in sampled]
    far = F.greatest(*(F.abs(F.col(f"n{k}") - F.col("n") * F.lit(q)) / F.sqrt(F.col("n") * F.lit(q)) for k, q in enumerate(share)))
    best = by_word.withColumn("far", far).where(F.col("far") >= TELLING).orderBy(F.col("far").desc(), "word").limit(TELLING_WORDS).collect()
    odds = {r["word"]: [(r[f"n{k}"] + 0.5) / (n + 1) for k, n in enumerate(sampled)] for r in best}
    telling = {w: centred([math.log(p / (1 - p)) for p in ps]) for w, ps in odds.items()}
    # A text without these words says something too.
    prior = tuple(x + sum(math.log(1 - ps[k]) for ps in odds.values()) for k, x in enumerate(prior))
    return Classifier(prior, weights, telling)


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with n_tokens (words) and posteriors (an array, one share a domain); columns of these names are replaced.

    A null or empty text has no tokens and the prior's posteriors. Texts are read whole, rows one by one.
    """
    kept = range(len(DOMAINS) - 1)
    table = lambda rows: [F.from_json(F.lit(json.dumps([w[k] for w in rows])), "array<double>") for k in kept]
    marks = sorted(model.telling)
    flat, alone = table(model.weights), table([model.telling[w] for w in marks])
    zero = F.struct(*(F.lit(0.0).alias(f"s{k}") for k in kept))
    summed = lambda places, w: F.aggregate(places, zero, lambda acc, x: F.struct(*((acc[f"s{k}"] + F.get(w[k], x)).alias(f"s{k}") for k in kept)))

    def scored(w: Column) -> Column:
        n = F.size(w)
        scale = F.least(n, F.lit(EVIDENCE)) / F.greatest(n, F.lit(1))
        if marks:
            hits = F.array_distinct(F.filter(w, lambda x: x.isin(marks)))
            places = F.transform(hits, lambda x: (F.array_position(F.split(F.lit(" ".join(marks)), " "), x) - 1).cast("int"))
        else:
            places = F.array().cast("array<int>")

        def soft(s: Column) -> Column:
            odds = [scale * s["all"][f"s{k}"] + s["alone"][f"s{k}"] for k in kept]
            odds.append(-sum(odds, F.lit(0.0)))
            logit = F.array(*(F.lit(p) + x for p, x in zip(model.prior, odds, strict=True)))
            shares = lambda x: let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, c: a + c)))
            return F.struct(n.cast("long").alias("n_tokens"), let(logit, shares).alias("posteriors"))

        return let(F.struct(summed(F.transform(w, _bucket), flat).alias("all"), summed(places, alone).alias("alone")), soft)

    found = let(words(F.col("text")), scored)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "posteriors")]
    return docs.select(*others, found.alias("posteriors")).withColumns({"n_tokens": F.col("posteriors.n_tokens"), "posteriors": F.col("posteriors.posteriors")})


def rate(posteriors: Column, steps: list[list[float]]) -> Column:
    """A document's rate after ``steps``: each adds p . step and projects onto what isn't negative."""
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), r + sum((F.get(posteriors, k) * F.lit(float(s)) for k, s in enumerate(step)), F.lit(0.0)))
    return r


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gauss elimination with pivots; a row without a pivot gets 0."""
    n = len(right)
    a = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for c in range(n):
        p = max(range(c, n), key=lambda i: abs(a[i][c]))
        a[c], a[p] = a[p], a[c]
        if abs(a[c][c]) > 1e-12:
            for i in range(n):
                if i != c:
                    f = a[i][c] / a[c][c]
                    a[i] = [x - f * y for x, y in zip(a[i], a[c], strict=True)]
    return [a[i][n] / a[i][i] if abs(a[i][i]) > 1e-12 else 0.0 for i in range(n)]


@dataclass(frozen=True)
class Mix:
    """Steps, and each domain's expected tokens with what was asked for (None: nothing)."""

    steps: list[list[float]]
    totals: list[float]
    targets: list[float | None]
    #: Domains that aren't within the tolerance: their tokens less their target, as a share of all.
    missed: dict[str, float] = field(default_factory=dict)

    def check(self, strict: bool) -> Mix:
        """Targets that can't be met (a domain without tokens, or too few passes) are an error or a warning, never silent."""
        if self.missed:
            said = "targets are missed by " + ", ".join(f"{d} {x:+.4f}" for d, x in self.missed.items())
            if strict:
                raise ValueError(said)
            warnings.warn(said, stacklevel=2)
        return self


def fit_rates(mass: DataFrame, targets: dict[str, float] | None = None, max_steps: int = 20, tolerance: float = 1e-4) -> Mix:
    """Steps of the projected least squares on ``mass`` (n_tokens, posteriors).

    The domain with the largest share keeps its tokens, and the others' targets are in proportion to it: all of them are
    fitted, a short domain's by rates above 1. A domain that ``targets`` leaves out has none, and its tokens go with the rates that the others
    get. Each pass tries the step scaled by the inverse of the K x K matrix of rates' effects over
    documents with a rate above 0, whole and shortened, and the one scaled by that matrix over all documents; the
    one that leaves the least squared error (in the scale of the latter, in which its step never adds to it) is kept, so that totals
    don't swing about their targets. ``max_steps`` bounds the passes; what is left is ``missed``.
    """
    wanted = targets or TARGETS
    held = [k for k, d in enumerate(DOMAINS) if d in wanted]
    n = len(held)
    p = [F.get("posteriors", k) for k in held]
    full = lambda step: [step[held.index(k)] if k in held else 0.0 for k in range(len(DOMAINS))]

    def totals(tried: list[list[list[float]]]) -> list[tuple[list[float], list[list[float]]]]:
        """Totals and matrix after each of several lists of steps, in one pass."""
        columns = []
        for i, steps in enumerate(tried):
            r = F.col(f"r{i}")
            columns += [F.sum(r * F.col("n_tokens") * p[k]) for k in range(n)]
            columns += [F.sum(F.when(r > 0, F.col("n_tokens") * p[i] * p[j]).otherwise(0.0)) for i in range(n) for j in range(i, n)]
        rates = mass.withColumns({f"r{i}": rate(F.col("posteriors"), [full(x) for x in steps]) for i, steps in enumerate(tried)})
        row = iter([x or 0.0 for x in rates.agg(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()])
        out = []
        for _ in tried:
            sums, matrix = [next(row) for _ in range(n)], [[0.0] * n for _ in range(n)]
            for i in range(n):
                for j in range(i, n):
                    matrix[i][j] = matrix[j][i] = next(row)
            out.append((sums, matrix))
        return out

    # A little of the diagonal on top keeps directions that hardly any document can move from swinging rates about.
    damped = lambda m: [[m[i][j] * (1 + DAMPING * (i == j)) + 1e-9 * (i == j) for j in range(n)] for i in range(n)]
    steps: list[list[float]] = []
    now, matrix = totals([steps])[0]
    whole = damped(matrix)
    shares = [wanted[DOMAINS[k]] for k in held]
    main = max((k for k in range(n) if now[k] > 0), key=lambda k: shares[k], default=0)
    scale = now[main] / shares[main] if n and shares[main] > 0 else 0.0
    goal = [x * scale for x in shares]

    def left(sums: list[float]) -> float:
        gap = [g - t for g, t in zip(goal, sums, strict=True)]
        return sum(x * y for x, y in zip(gap, _solve(whole, gap), strict=True))

    while len(steps) < max_steps and any(abs(g - t) > tolerance * max(sum(goal), 1e-9) for g, t in zip(goal, now, strict=True)):
        gap = [g - t for g, t in zip(goal, now, strict=True)]
        fast = _solve(damped(matrix), gap)
        tried = [[*steps, step] for step in ([fast] + [[x * share for x in fast] for share in SHORTENED] + [_solve(whole, gap)])]
        steps, (now, matrix) = min(zip(tried, totals(tried), strict=True), key=lambda x: left(x[1][0]))
    all_ = max(sum(goal), 1e-9)
    missed = {DOMAINS[k]: (t - g) / all_ for k, g, t in zip(held, goal, now, strict=True) if abs(t - g) > 10 * tolerance * all_}
    by_domain = dict(zip(held, zip(now, goal, strict=True), strict=True))
    return Mix([full(x) for x in steps], [by_domain.get(k, (0.0, None))[0] for k in range(len(DOMAINS))], [by_domain.get(k, (0.0, None))[1] for k in range(len(DOMAINS))], missed)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, strict: bool = False, **options) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate) for every row of ``docs`` (doc_id, text; others are ignored, whatever their names).

    Repeated rows have the same rate, each their own row. Null and empty texts have no tokens and move nothing; null ids stay. Texts are read whole. An empty
    table gives an empty result. Targets that can't be met are a warning, with ``strict`` an error.
    """
    model = fit(docs, labels, **options)
    mass = stored(with_posteriors(docs.select("doc_id", "text"), model).select("doc_id", "n_tokens", "posteriors"), "mass")
    mix = fit_rates(mass, targets).check(strict)
    return mass.select("doc_id", "n_tokens", *(F.get("posteriors", k).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), rate(F.col("posteriors"), mix.steps).alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, strict: bool = False, **options) -> DataFrame:
    """``docs`` dealt out at their rates: whole copies, and one more with the odds of the rest.

    The coin is a hash of doc_id (of the text, where that is null), so rows that repeat an id are dealt alike. Posteriors are computed for the totals and
    once more where the rates apply, which costs a second pass of the texts and spares shuffling them. Columns stay, whatever their names. Nulls, empty
    tables and targets that can't be met are as in ``mixing_rates``.
    """
    model = fit(docs, labels, **options)
    mass = stored(with_posteriors(docs.select("doc_id", "text"), model).select("n_tokens", "posteriors"), "mass")
    mix = fit_rates(mass, targets).check(strict)
    coin = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("mix"), "doc_id")), F.xxhash64(F.lit("mix"), "text"))
    odds = F.shiftrightunsigned(coin, 11) / F.lit(float(1 << 53))
    # Rates of 1 that rounding has moved by a hair stay 1.
    near = F.round(rate(F.col("posteriors"), mix.steps), 12)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row__"), "doc_id", "text")
    dealt = with_posteriors(row, model).withColumn("copies__", F.floor(near + odds).cast("int")).where("copies__ > 0")
    return dealt.withColumn("copy__", F.explode(F.array_repeat(F.lit(1), F.col("copies__")))).select("row__.*")

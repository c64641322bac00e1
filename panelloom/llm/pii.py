"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

All on the main path is DataFrame expressions. Regular expressions give matches and the pieces between them,
whose lengths add up to positions in code points. The trees are fitted on the driver from a
table of distinct feature rows, and compiled into one CASE expression.

What the trees judge are spans in unusual forms, for which there are no labels. They learn from planted ones: where a text holds a
span that the base rules prove, its value is written in an unusual form in the span's own surroundings (right), and something that
has that form by chance is put into nearby prose (wrong). So a label says where a span comes from; it isn't computed from its features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import cut, let, pieces_of, running, sample_ids

#: The kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")

#: Base generators. They match what the plain rules match, but a run of characters is entered at its start only
#: (or where the last match ended), so that a long run costs a single pass. Cards are searched in a text
#: whose single separators between digits are made one private character.
_MARK = "\ue000"
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": f"[0-9{_MARK}]{{2,}}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no base match that counts.
_MAYBE = {
    "email": r"@[A-Za-z0-9-]++\.",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
#: Wide generators: high recall, left to the trees.
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|＠) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:00[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
_WIDE_MAYBE = {
    "email": r"(?:\(at\)|\[at\]|\{at\}|＠)",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:",
    "card": r"[0-9]{4}[./_]{1,2}[0-9]{4}[./_]",
    "phone": r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}",
}
#: Words that stand before each kind.
_CONTEXT = {
    "email": "mail|contact|write|reach|address|kontakt|correo|courriel",
    "ip": "ip|host|server|addr|login|from",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta|iban",
    "phone": "phone|tel|call|mobile|cell|fax|ruf|appel|llam",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPANS = "array<struct<kind:int,start:int,end:int,match:string,wide:int,before:string,prose:string,after:string>>"
#: Code points before a span that count as its surroundings; they don't reach back beyond the kind's last match.
_NEAR = 24


def _matches(text: Column, pattern: str, kind: int, wide: int) -> Column:
    """All matches with their code-point places and surroundings, in time that grows with text and matches."""

    def of(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        each = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda f, g: F.length(f) + F.length(g))

        def spans(ends: Column) -> Column:
            return F.transform(
                found,
                lambda f, i: F.struct(
                    F.lit(kind).alias("kind"), (F.get(ends, i) + F.length(F.get(gaps, i))).cast("int").alias("start"), F.get(ends, i + 1).cast("int").alias("end"), f.alias("match"), F.lit(wide).alias("wide"),
                    F.substring(F.get(gaps, i), -_NEAR, _NEAR).alias("before"),
                    F.substring(F.get(gaps, i), 1, 2 * _NEAR).alias("prose"), F.substring(F.get(gaps, i + 1), 1, 1).alias("after"),
                ),
            )

        return let(running(each, F.lit(0), lambda a, b: a + b), spans)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), of)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """Do the digits of a base match count?"""
    digits = F.length(_digits(match))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == 2, F.when(digits.between(14, 19), _luhn(_digits(match))).otherwise(F.lit(False)))
        .otherwise(digits.between(10, 15))
    )


def candidates(text: Column) -> Column:
    """All proposed spans of a text, base and wide, with whether the base keeps them."""
    none = F.array().cast(_SPANS)
    found = []
    for k, kind in enumerate(KINDS):
        where = F.regexp_replace(F.translate(text, _MARK, "?"), r"(?<=[0-9])[\x20-](?=[0-9])", _MARK) if kind == "card" else text
        found.append(F.when(text.rlike(_MAYBE[kind]), _matches(where, _BASE[kind], k, 0)).otherwise(none))
    for k, kind in enumerate(KINDS):
        found.append(F.when(text.rlike(_WIDE_MAYBE[kind]), _matches(text, _WIDE[kind], k, 1)).otherwise(none))
    return F.transform(F.concat(*found), lambda s: s.withField("base", (s["wide"] == 0) & _valid(s["kind"], s["match"])))


#: Format and context features, all small whole numbers.
FEATURES = ("kind", "digits", "length", "groups", "luhn", "octets", "named", "joined", "letters")


def features(s: Column) -> list[Column]:
    match, kind = s["match"], s["kind"]
    before = F.lower(s["before"])
    digits = F.length(_digits(match))
    named = F.lit(False)
    for k, words in enumerate(_CONTEXT[x] for x in KINDS):
        named = named | ((kind == k) & before.rlike(rf"(?:{words})[^A-Za-z]{{0,12}}$"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [
        kind, F.least(digits, F.lit(24)), F.least(F.length(match), F.lit(60)),
        F.least(F.size(F.split(match, rf"[^A-Za-z0-9{_MARK}]+|{_MARK}")) - 1, F.lit(9)),
        flag(F.when(digits.between(12, 19), _luhn(_digits(match))).otherwise(F.lit(False))),
        flag(match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | match.contains(":")),
        flag(named), flag(before.rlike("[a-z0-9]$") | s["after"].rlike("[A-Za-z0-9]")),
        flag(match.rlike(r"[A-Za-z]{2,}[)\]}]?$")),
    ]


def planted(s: Column, gap: Column) -> tuple[Column, Column]:
    """Of a proved span and the text before it: its value in an unusual form, and something of that form by chance (null: none).

    The form varies with the value's hash.
    """
    kind, match = s["kind"], s["match"]
    digits = _digits(match)
    style = F.pmod(F.xxhash64(match), F.lit(3))
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (style + 1).cast("int"))
    grouped = lambda d: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), pick(".", "/", "_")))
    called = lambda d: F.concat(pick("(", "", ""), F.substring(d, 1, 3), pick(") ", "-", "."), F.substring(d, 4, 3), pick("-", "-", "."), F.substring(d, 7, 4))
    host = F.substring_index(match, "@", -1)
    right = (
        F.when(kind == 0, F.concat(F.substring_index(match, "@", 1), pick("(at)", " [at] ", " (at) "), F.when(style == 0, host).otherwise(F.replace(host, F.lit("."), pick(".", "[dot]", " (dot) ")))))
        .when(kind == 1, F.regexp_replace(F.md5(match), "(.{4})(?=.)", "$1:"))
        .when((kind == 2) & (F.length(digits) == 16), grouped(digits))
        .when((kind == 3) & (F.length(digits) >= 10), called(F.substring(digits, -10, 10)))
    )
    other = F.conv(F.substring(F.md5(match), 1, 14), 16, 10)
    other = F.substring(F.concat(other, other), 1, 16)  # digits that stand for nothing
    prose = lambda k: F.regexp_extract(gap, "([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)", k)
    wrong = (
        F.when((kind == 0) & (prose(1) != ""), F.concat(prose(1), pick("(at)", " [at] ", " (at) "), prose(2), F.lit(". "), prose(3)))
        .when(kind == 1, F.concat_ws(":", *(F.substring(other, 2 * k + 1, 2) for k in range(8))))
        .when(kind == 2, grouped(other))
        .when(kind == 3, called(F.substring(other, 1, 10)))
    )
    return right, F.when(F.length(gap) >= 2 * _NEAR, wrong)


# --- boosted trees on a bounded table of (features, label, weight) -----------------------------------------


@dataclass
class Trees:
    """Depth-2 regression trees on the logit, and a threshold for each kind (None: its unusual forms are never chosen)."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: list[float | None] = field(default_factory=lambda: [None] * len(KINDS))

    def score(self, row) -> float:
        total = self.start
        for node in self.trees:
            while len(node) == 4:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node[0]
        return total

    def expression(self, f: list[Column]) -> Column:
        def walk(node) -> Column:
            if len(node) == 1:
                return F.lit(float(node[0]))
            return F.when(f[node[0]] <= node[1], walk(node[2])).otherwise(walk(node[3]))

        total = F.lit(float(self.start))
        for node in self.trees:
            total = total + walk(node)
        return total


def _tree(rows: list, grad: list[float], hess: list[float], at: list[int], depth: int, rate: float) -> tuple:
    g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
    best = None
    if depth:
        for c in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in at:
                s = by.setdefault(rows[i][c], [0.0, 0.0])
                s[0] += grad[i]
                s[1] += hess[i]
            left_g = left_h = 0.0
            for v in sorted(by)[:-1]:
                left_g += by[v][0]
                left_h += by[v][1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, c, v)
    if best is None:
        return (rate * g / (h + 1),)
    _, c, v = best
    low, high = [i for i in at if rows[i][c] <= v], [i for i in at if rows[i][c] > v]
    return (c, v, _tree(rows, grad, hess, low, depth - 1, rate), _tree(rows, grad, hess, high, depth - 1, rate))


def boost(table: list[tuple[tuple[int, ...], int, int, int]], rounds: int = 25, rate: float = 0.4, precision: float = 0.9) -> Trees:
    """Trees from (features, label, fold, weight) rows: fold 0 fits, fold 1 calibrates.

    A kind's threshold is the least score at which the calibration fold's spans reach ``precision`` (with one
    wrong span added, so that a few rows prove nothing); a kind without that is never added. Random digits pass a card's check one time in ten, which
    is why ``precision`` is no higher.
    """
    fit = [r for r in table if r[2] == 0] or table
    model = Trees()
    pos, all_ = sum(w for _, y, _, w in fit if y), sum(w for _, _, _, w in fit)
    if not fit or pos in (0, all_):
        return model
    model.start = math.log(pos / (all_ - pos))
    rows, logit = [r[0] for r in fit], [model.start] * len(fit)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-x)) for x in logit]
        grad = [w * (y - q) for (_, y, _, w), q in zip(fit, p, strict=True)]
        hess = [w * q * (1 - q) for (_, _, _, w), q in zip(fit, p, strict=True)]
        tree = _tree(rows, grad, hess, list(range(len(fit))), 2, rate)
        model.trees.append(tree)
        step = Trees(0.0, [tree])
        logit = [x + step.score(r) for x, r in zip(logit, rows, strict=True)]
    for k in range(len(KINDS)):
        held = sorted(((model.score(f), y, w) for f, y, fold, w in table if f[0] == k and fold == 1), reverse=True)
        good, bad, i = 0, 1, 0
        while i < len(held):
            j = i
            while j < len(held) and held[j][0] == held[i][0]:
                good, bad, j = good + held[j][1] * held[j][2], bad + (1 - held[j][1]) * held[j][2], j + 1
            if good / (good + bad) >= precision and held[i][0] > 0:
                model.thresholds[k] = held[i][0]
            i = j
    return model


def training(docs: DataFrame) -> DataFrame:
    """(doc_id, features..., label): planted spans of all documents, as the wide generators propose them."""
    of = lambda t: F.filter(candidates(t), lambda s: s["base"])
    text = F.coalesce(F.col("text"), F.lit(""))
    proved = docs.where("doc_id is not null").select("doc_id", F.explode(of(text)).alias("s"))

    def plants(s: Column) -> Column:
        right, wrong = planted(s, s["prose"])
        row = lambda v, before, label: F.struct(v.alias("value"), before.alias("before"), F.lit(label).alias("label"))
        return F.array(row(right, s["before"], 1), row(wrong, s["prose"], 0))

    put = proved.select("doc_id", F.explode(plants(F.col("s"))).alias("p")).where("p.value is not null")
    put = put.withColumn("t", F.concat(F.col("p.before"), F.lit(" "), F.col("p.value"), F.lit(" ")))
    seen = put.select("doc_id", "p", F.explode(candidates(F.col("t"))).alias("s")).where("s.wide = 1")
    at = F.length(F.col("p.before")) + 1
    whole = (F.col("s.start") <= at) & (F.col("s.end") >= at + F.length(F.col("p.value")))
    label = (whole & (F.col("p.label") == 1)).cast("int").alias("label")
    return seen.select("doc_id", *(c.cast("int").alias(n) for n, c in zip(FEATURES, features(F.col("s")), strict=True)), label)


def fit(docs: DataFrame, sample_docs: int = 20_000) -> Trees:
    """Trees for ``docs``, fitted on planted spans of half of at most ``sample_docs`` documents: those whose ids have the least hashes.

    All other documents calibrate the thresholds, so that a rare kind is judged by all there is of it. The sample's ids
    alone are broadcast, so its size bounds that; what comes to the driver is the table of distinct feature rows, whose
    number the features' ranges bound. Without proved spans of a kind there is no threshold for it.
    """
    share = 1 << 40
    total = docs.where("doc_id is not null").count()
    # A cut by the hash's range keeps the sample's share before ids are compared.
    near = docs.select("doc_id").where("doc_id is not null")
    if total > 2 * sample_docs:
        near = near.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < F.lit(share * 3 * sample_docs // (2 * total)))
    ids = sample_ids(near.distinct(), "doc_id", sample_docs).withColumn("sampled", F.lit(True))
    half = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")
    known = training(docs.select("doc_id", "text")).join(F.broadcast(ids), "doc_id", "left").withColumn("fold", F.when(F.col("sampled"), half).otherwise(1))
    rows = known.groupBy(*FEATURES, "label", "fold").count().collect()
    return boost(sorted((tuple(r[n] for n in FEATURES), r["label"], r["fold"], r["count"]) for r in rows))


_CHOSEN = "array<struct<start:int,kind:int,end:int,base:boolean>>"


def _clear_of(base: Column, wide: Column) -> Column:
    """The spans of ``wide`` that no span of ``base`` of their kind overlaps: one sorted pass, not all pairs."""
    shift = F.lit(1 << 32)

    def of(all_: Column) -> Column:
        key = lambda s, x: s["kind"] * shift + s[x]
        ends = F.transform(all_, lambda s: F.when(s["base"], key(s, "end")).otherwise(F.lit(-1)))
        starts = F.reverse(F.transform(all_, lambda s: F.when(s["base"], key(s, "start")).otherwise(F.lit(1 << 62))))
        n = F.size(all_)
        reach = F.struct(running(ends, F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b)).alias("last"), running(starts, F.lit(1 << 62), lambda a, b: F.least(a, b)).alias("next"))

        def kept(r: Column) -> Column:
            free = lambda s, i: ~s["base"] & (F.get(r["last"], i) <= key(s, "start")) & (F.get(r["next"], n - 1 - i) >= key(s, "end"))
            return F.filter(all_, free)

        return let(reach, kept)

    plain = lambda xs: F.transform(xs, lambda s: F.struct(s["kind"].cast("long").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return let(F.sort_array(F.concat(plain(base), plain(wide))), of)


def find(docs: DataFrame, model: Trees | None = None, column: str = "pii") -> DataFrame:
    """``docs`` (doc_id, text, others) with an array ``column`` of spans (start, kind, end, base), in order.

    ``kind`` is the place in KINDS, ``end`` is exclusive, both count code points. Base spans always stay; others
    stay if the trees' score reaches their kind's threshold and no base span of the kind overlaps them. Null
    and empty texts have no spans. Rows are independent, so repeated rows are judged alike, and an empty table gives an empty result. Texts are
    searched whole, in time that grows with their length and their spans. Other columns stay; one named ``column`` is replaced.
    """
    model = fit(docs) if model is None else model
    text = F.coalesce(F.col("text"), F.lit(""))

    def score(s: Column) -> Column:
        return let(F.struct(*(c.alias(f"f{i}") for i, c in enumerate(features(s)))), lambda f: model.expression([f[f"f{i}"] for i in range(len(FEATURES))]))

    def enough(s: Column) -> Column:
        out = F.lit(False)
        for k, t in enumerate(model.thresholds):
            if t is not None:
                out = out | ((s["kind"] == k) & (score(s) >= t - 1e-9))
        return (s["wide"] == 1) & out

    def chosen(all_: Column) -> Column:
        def with_wide(wide: Column) -> Column:
            base = F.filter(all_, lambda s: s["base"])
            slim = lambda xs: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["kind"].cast("int").alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
            return F.when(F.size(wide) == 0, F.sort_array(slim(base))).otherwise(F.sort_array(F.concat(slim(base), slim(_clear_of(base, wide)))))

        return F.when(F.size(all_) == 0, F.array().cast(_CHOSEN)).otherwise(let(F.filter(all_, enough), with_wide))

    return docs.withColumn(column, let(candidates(text), chosen))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*(F.lit(x) for x in KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; spans that overlap become one, named by the first.

    n_chars, where there is one, follows the new text. All rows and columns stay, whatever the names of those beside text.
    """
    model = fit(docs) if model is None else model
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row__"), F.col("text"))
    found = find(held, model, "pii__")
    name = lambda k: F.element_at(F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS)), k + 1)

    def rebuilt(spans: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            # A span that starts behind all before it opens a gap; it has text since the last end.
            opens = F.filter(F.transform(spans, lambda s, i: F.struct(F.get(ends, i).alias("since"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda o: o["start"] >= o["since"])
            return let(
                pieces_of(F.col("text")),
                lambda p: F.concat(F.array_join(F.transform(opens, lambda o: F.concat(cut(p, o["since"], o["start"]), name(o["kind"]))), ""), cut(p, F.element_at(ends, -1), F.length("text"))),
            )

        return let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), with_ends)

    some = F.size("pii__") > 0
    changed = found.select("row__", some.alias("some__"), F.when(some, rebuilt(F.col("pii__"))).otherwise(F.col("text")).alias("text__"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text__").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("some__"), F.length("text__").cast(docs.schema[c].dataType)).otherwise(F.col("row__.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row__.`{c}`"))
    return changed.select(*columns)

"""URL filters: allow and block rules, and for other urls a weighted vocabulary matched by Aho-Corasick.

A strict term rejects alone; soft terms reject when enough different ones occur. Terms count only where they
stand as words: no letter or digit right before or after.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules as (action, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The vocabulary.
STRICT = ("porn", "porno", "xxx", "xvideos", "hentai", "escort", "escorts", "camgirl", "camgirls", "nsfw", "adult", "casino", "casinos", "viagra", "cialis", "spam", "warez", "phishing", "malware")
SOFT = ("free", "win", "winner", "bets", "bet", "betting", "poker", "slots", "jackpot", "cheap", "pills", "pharmacy", "discount", "deal", "deals", "ads", "track", "tracker", "click", "clicks", "sex", "nude", "dating", "loan", "loans", "crypto", "farm", "hot", "girls", "bonus")
SOFT_LIMIT = 2
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z in lower case; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, *_LOWER)


def path_of(url: Column) -> Column:
    """Behind the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null: a rule's host is the url's or a domain above it, its path a prefix."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Different strict and soft terms in a url, percent-decoded and in lower case."""
    if not url or not (strict or soft):
        return 0, 0
    text = unquote(url).lower()
    seen: set[tuple[str, bool]] = set()
    for end, hit in _automaton(strict, soft).iter(text):
        start = end - len(hit[0]) + 1
        if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            seen.add(hit)
    return sum(s for _, s in seen), sum(not s for _, s in seen)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits) of every row of ``pages`` (page_id, url).

    The verdict is the longest fitting rule's; without one, block if a strict term or ``soft_limit`` different soft terms occur, else
    allow. Null urls and those without :// have an empty host and path; the former are allowed. Rows are independent: repeated rows are judged alike, null
    ids stay, and an empty table gives an empty result. Urls are read whole, in time that grows with their length. Columns beside page_id and url are ignored,
    whatever their names.
    """
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    action = F.lit(None).cast("string")
    for what, rule in rules:
        action = F.when(F.col("rule") == rule, F.lit(what)).otherwise(action)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [hits(u, strict, soft) for u in batch.column("url").to_pylist()]
            columns = [*(batch.column(c) for c in ("page_id", "host", "path", "rule", "action")), pa.array([c[0] for c in counts], pa.int32()), pa.array([c[1] for c in counts], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "action", "strict_hits", "soft_hits"])

    counted = ruled.withColumn("action", action).mapInArrow(run, "page_id long, host string, path string, rule string, action string, strict_hits int, soft_hits int")
    method = F.when((F.col("strict_hits") >= 1) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    return counted.select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"), "strict_hits", "soft_hits")

from __future__ import annotations

import collections
import hashlib
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import chat, html_text, queries, topk, url_filter, warc

# --- top-k ---------------------------------------------------------------------------------------------------------


def brute_top(rows, asked, k, scale):
    whole = {i: [math.floor(scale * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in asked & set(whole):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize(("kind", "bucket", "block"), [("unit", 40, 7), ("skewed", 16, 3), ("same", 32, 8), ("close", 16, 5)])
def test_top_k_equals_brute_force(spark, kind, bucket, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 6))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif kind == "skewed":
        v *= rng.pareto(1.0, (200, 1)) + 0.1
    elif kind == "same":
        v[:90] = v[0]
    else:
        v = np.repeat(rng.normal(size=(10, 6)), 20, axis=0) + rng.normal(scale=0.01, size=(200, 6))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(500, None), (501, [1.0, None, 0, 0, 0, 0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (504, [0.0] * 6)]
    df = spark.createDataFrame([(i, x and [None if y is None else float(y) for y in x], "z") for i, x in rows], "vec_id long, embedding array<double>, rank string")
    asked = {i for i, _ in rows if i is not None and i % 9 == 0}
    got = topk.top_k(df, df.where(F.col("vec_id").isin(sorted(asked))), k=7, bucket=bucket, block=block)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, asked, 7, 64.0)


def test_top_k_of_large_components(spark):
    """Finite components of any size take part; products beyond doubles' whole numbers are exact."""
    schema = "vec_id long, embedding array<double>"
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2e9, 0.0]), (2, [0.5, 0.0])], schema)
    assert [tuple(r)[1:] for r in topk.top_k(three, three.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 64 * 128_000_000_000), (2, 2, 2048)]
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-(10**6), 10**6, 5)]) for i in range(60)]
    rows += [(60, [1e12, 1.0, 0.0, 0.0, 0.0]), (61, [1e12, 1.0, 1.0, 0.0, 0.0]), (62, [0.25, 0.0, 0.0, 0.0, 0.0]), (63, [2.0**-9, 0.0, 0.0, 0.0, 0.0]), (64, [1e-300] * 5)]
    df = spark.createDataFrame(rows, schema)
    asked = {i for i in range(65) if i not in (60, 61)}
    got = topk.top_k(df, df.where(F.col("vec_id").isin(sorted(asked))), k=6, scale=1.0, bucket=8, block=8)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, asked, 6, 1.0)
    with pytest.raises(Exception, match="leaves 64 bits"):
        topk.top_k(df, df.where("vec_id = 60"), scale=1.0).collect()
    # Enough higher scores: one that leaves 64 bits downwards isn't asked for.
    low = spark.createDataFrame([(0, [1e10]), (1, [1.0]), (2, [-1e10])], schema)
    assert [tuple(r) for r in topk.top_k(low, low.where("vec_id = 0"), k=1, scale=1.0).collect()] == [(0, 1, 1, 10**10)]
    with pytest.raises(Exception, match="leaves 64 bits"):
        topk.top_k(low, low.where("vec_id = 0"), k=2, scale=1.0).collect()
    huge = df.union(spark.createDataFrame([(99, [1e300, 0.0, 0.0, 0.0, 0.0])], schema))
    with pytest.raises(Exception, match="1e\\+150 or more"):
        topk.top_k(huge, df.where("vec_id = 1")).collect()


def test_top_k_repeated_rows_and_differing_widths(spark):
    rows = [(1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0]), (3, [0.0, 2.0, 5.0]), (4, [])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, part string, longest double")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id = 2"), k=3, scale=1.0).collect())
    assert got == [(2, 1, 1, 1), (2, 2, 1, 1), (2, 3, 3, 0)]


def test_top_k_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)
    assert [tuple(r) for r in topk.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 2048)]
    assert topk.top_k(two.where("false"), two.where("false")).collect() == []


# --- chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["\\", "</turn>", "### User: x", "\\</turn>\n### ", "<\\/turn>", "#\\## ", "#### \\\\", "", None, "😀\n\n", "a: b"]
    roles = ["system", "user", "assistant", "tool", "@odd: role~.~~\\", "User", None]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(roles), rng.choice(nasty), "x") for c in range(60) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    want = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t, role or "", text or ""))
    out = chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert len(out) == 60
    for r in out:
        turns = [(role, text) for _, role, text in sorted(want[r["conv_id"]])]
        assert [tuple(x) for x in r["turns"]] == turns
        assert r["loss"] == "".join(text for role, text in turns if role == "assistant")
        assert r["formatted"].count("</turn>\n") == len(turns)


def test_chat_order(spark):
    cases = {1: ["user", "assistant"], 2: ["assistant"], 3: ["system", "user"], 4: ["user", "user"], 5: ["system"], 6: ["user", "assistant", "tool", "assistant", "user"], 7: [None]}
    df = spark.createDataFrame([(c, t, r, "x") for c, rs in cases.items() for t, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["valid"], r["failed_at"]) for r in chat.format_chats(df).collect()}
    assert got == {1: (True, None), 2: (False, 0), 3: (True, None), 4: (False, 1), 5: (False, None), 6: (True, None), 7: (False, 0)}
    assert chat.format_chats(df.where("false")).collect() == []


def test_chat_repeats_nulls_and_long_texts(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", None), (1, 0, "user", "x" * 500_000), (1, 0, "user", "x" * 500_000)]
    got = {r["conv_id"]: (r["formatted"].count("</turn>"), r["valid"]) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {None: (2, True), 1: (2, False)}


def test_urls_repeated_null_and_long(spark):
    rows = [(1, "http://x.org/casino", "a"), (1, "http://x.org/casino", "a"), (None, None, "a"), (2, "http://x.org/" + "a/" * 200_000, "a")]
    got = sorted((str(r["page_id"]), r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect())
    assert got == [("1", "block"), ("1", "block"), ("2", "allow"), ("None", "allow")]


def test_chat_query(spark, sf):
    text = "\\### Assistant: </turn> ok"
    r = queries.QUERIES["op5_chat_format"](spark, sf).where("conv_id = -7").first()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"], r["valid"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest(), True)


# --- archives ------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/\r\nX: y", big), (5, None, big), (3, "u", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", big), (9, "u", "\r\n\r\nWARC/1.1" * 200), (10, "u", "x" * 300_000), (8, "u", other)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"] is None, r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.round_trip(df.drop("digest"), payloads=True).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == data and j is not None]
        revisit = len(data) >= 1000 and i is not None and i < max(same)
        want.append(((i is None, i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None, None if revisit else data))
    assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got] == sorted(want)
    assert warc.round_trip(df.where("false").drop("digest")).collect() == []


def test_archives_are_bounded_and_read_apart(spark):
    rows = [(i, "u", f"{i} " * 2000) for i in range(48)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, "page_id")
    back = warc.round_trip(df, archive_bytes=200)
    used = back.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in used) == 48 and len(used) >= 12
    assert {r["page_id"] for r in back.collect()} == set(range(48))


def test_archives_detect_damage():
    good = warc.record(1, "u", "payload " * 50, None)
    assert [warc.unpack(m)["page_id"] for m in warc.members(io.BytesIO(good + warc.record(2, "u", None, None)))] == [1, 2]
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.members(io.BytesIO(good[:-9])))
    member = next(warc.members(io.BytesIO(good)))
    with pytest.raises(ValueError, match="digest"):
        warc.unpack(member.replace(b"payload payload", b"payload paylaod", 1))
    with pytest.raises(ValueError, match="as long as"):
        warc.unpack(member[:-6])


# --- pages ---------------------------------------------------------------------------------------------------------

LONG = "This sentence is part of the article and long enough to be told from a menu. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<nav><ul><li>Home</nav>", ""),
        ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><article><h1>Head &amp; tail</h1><p>Short.<p>One\n  two<script>var x='</p>';</script> three</article><footer>foot</footer>", "Head & tail\n\nShort.\n\nOne two three"),
        (f"<div class='top-menu'><a href=x>Home</a></div><h1>Title</h1><p>{LONG}</p><p>Ok.</p><p>{LONG}</p><div id=comments><p>{LONG}</p></div><div>links</div>".replace("<div>links</div>", "<div><a>links</a></div>"), f"Title\n\n{LONG.strip()}\n\nOk.\n\n{LONG.strip()}"),
        (f"<p class=ad>buy<p>{LONG}<!-- <p>no</p> -->", LONG.strip()),
        ("<article><p>a<aside><p>side<div>x</div></aside><p>b<form><input><p>f</form></article>", "a\n\nb"),
        ("<article><p>3 < 4 &lt; 5 &copy; &#65;&#x42; &nbsp; end</p></article>", "3 < 4 < 5 © AB end"),
        ("<article><table><tr><td>1<td>2</table><ul><li>x<li>y</ul></article>", "1\n\n2\n\nx\n\ny"),
        ("<p>Short page.</p>", "Short page."),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


WRAPPED = f"<div class='layout has-sidebar'>%s<p>{LONG}</p><p>Ok.</p><div class='sidebar'>side</div><ul><li class=ad><p>buy</p><li>{LONG}</ul></div>"


@pytest.mark.parametrize("head", ["<h1>Title</h1>", ""])
def test_a_mark_on_a_wrapper_keeps_the_article(head):
    want = ["Title"] * bool(head) + [LONG.strip(), "Ok.", LONG.strip()]
    assert html_text.main_text(WRAPPED % head).split("\n\n") == want
    assert html_text.main_text(f"<p title=it\"s>{LONG}</p>") == LONG.strip()
    comments = f"<div id=comments><article class=comment><p>{LONG * 4}</p></article></div>"
    assert html_text.main_text(f"<main><h1>Title</h1><p>{LONG}</p>{comments}</main>") == f"Title\n\n{LONG.strip()}"


def windowed(blocks, article):
    """The article of (text, characters in links, heading) blocks, those numbered ``article`` marked; windows of three blocks counted one by one."""
    bare = [len(t) - k for t, k, _ in blocks]
    peak = max(sum(bare[i : i + 3]) for i in range(max(1, len(bare) - 2)))
    surge = min(60, peak / 4)
    if surge == 0:
        return ""
    w = [x + (0.3 * surge if i in article else 0) for i, x in enumerate(bare)]
    first = min(i for i in range(len(w)) if w[i] and sum(w[i : i + 3]) >= surge - 1e-9)
    last = max([first] + [i for i in range(len(w)) if w[i] and sum(w[max(0, i - 2) : i + 1]) >= surge - 1e-9])
    while first and blocks[first - 1][2]:
        first -= 1
    return "\n\n".join(t for t, _, _ in blocks[first : last + 1])


@pytest.mark.parametrize("seed", range(30))
def test_windows_decide(seed):
    """Pages made of blocks whose lengths are known: the ends are where the windows say, with a marked article and without, and they do cut."""
    rng, cut = random.Random(seed), 0
    for _ in range(20):
        blocks, html = [], []
        start = rng.randrange(8)
        article = set(range(start, start + rng.choice([0, 0, 2, 5])))
        for i in range(rng.randint(1, 16)):
            text = " ".join("x" * rng.randint(1, 9) for _ in range(rng.choice([1, 1, 1, 2, 3, 30]))) + str(i)
            link, tag = rng.random() < 0.3, rng.choice(["p", "div", "h2"])
            blocks.append((text, len(text) if link else 0, tag == "h2"))
            html.append(("<article>" if i == start and article else "") + f"<{tag}>" + (f"<a href=u>{text}</a>" if link else text) + f"</{tag}>" + ("</article>" if article and i == max(article) else ""))
        want = windowed(blocks, article)
        assert html_text.main_text("<body>" + "".join(html)) == want
        cut += want != "\n\n".join(t for t, _, _ in blocks)
    assert cut > 3


def test_a_marked_card_takes_nothing_from_the_prose():
    prose = "Some sentence here. " * 40
    assert html_text.main_text(f"<div><h1>T</h1><p>{prose}</p></div><article><p>card</p></article>") == f"T\n\n{prose.strip()}\n\ncard"
    # A mark without text doesn't make an article, nor does one on links alone.
    far = "<p>a</p>" * 5
    assert html_text.main_text(f"<p>{prose}</p>{far}<article><p><a>one</a></p><p><a>two</a></p><p><a>three</a></p></article>") == f"{prose.strip()}\n\na\n\na"
    assert html_text.main_text("<article><p>One.</p><p>Two.</p><p>3</p></article>") == "One.\n\nTwo.\n\n3"


def test_all_text_of_the_given_articles_stays(spark):
    """On the given pages nothing but the article is left when markup is gone: windows must cut none of it, thin lines at its ends included."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        lines = html_text.lines_of(r["html"] or "")
        assert html_text.main_text(r["html"]) == "\n\n".join(x.text for x in lines)


def test_pages_long_repeated_and_none(spark):
    page = f"<article>{f'<p>{LONG}</p>' * 20_000}</article>"
    df = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, None, "", 1)], "page_id long, url string, html string, n_chars int")
    assert sorted(r["n_chars"] for r in html_text.extract(df).collect()) == [0] + [20_000 * (len(LONG) + 1) - 2] * 2
    assert html_text.extract(df.where("false")).collect() == []


def test_main_text_survives_odd_markup():
    for odd in ("<" * 5000, "<a " * 5000, "<p class='" + "x" * 9000, "&" * 5000, "<div>" * 3000 + "x", "<!--" * 2000, "<script>" + "y" * 9000, "<article>" * 2000, "<div class=ad>" * 30_000 + "x", "<li class=ad><ul>" * 30_000, "<p class=ad>x" * 30_000):
        html_text.main_text(odd)


def test_pages_query(spark, sf):
    rows = queries.QUERIES["op9_html_text"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in rows:
        assert r["n_chars"] == len(r["text"]) > 0
        assert "©" not in r["text"] and "<p" not in r["text"]
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>hello", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("", 0), ("hello", 5)]


# --- urls ----------------------------------------------------------------------------------------------------------


def test_url_parts_rules_and_words(spark):
    cases = [
        (1, "HTTP://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "http://b.www.example.com/en/1", "b.www.example.com", "/en/1", "www.example.com/en/", "allow"), (4, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), (5, "http://x.net/es", "x.net", "/es", None, "allow"),
        (6, "http://casino.com", "casino.com", "", None, "block"), (7, "http://casino.com/", "casino.com", "/", "com/", "allow"), (8, None, "", "", None, "allow"), (9, "no scheme/en/", "", "", None, "allow"),
        (10, "http://cheap.org/free", "cheap.org", "/free", None, "block"), (11, "http://cheap.org/cheaper", "cheap.org", "/cheaper", None, "allow"), (12, "http://x.org/?a=http://y.net/es/", "x.org", "/", None, "allow"),
        (13, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (14, "://É.org/a\nb?c", "É.org", "/a\nb", None, "allow"), (15, "http://x.org/%78xx", "x.org", "/%78xx", None, "block"), (16, "http://cheap.org/cheap", "cheap.org", "/cheap", None, "allow"),
    ]
    df = spark.createDataFrame([(c[0], c[1], "x") for c in cases], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[:5] for r in url_filter.judge(df).collect()}
    for c in cases:
        assert got[c[0]] == (c[0], *c[2:]), c
    assert url_filter.judge(df.where("false")).collect() == []
    assert url_filter.hits("http://sex-free.org/sexy") == (0, 2)


def test_url_words_end_at_letters_of_any_script(spark, tmp_path):
    """The operator and its SQL alike: an accented or other letter, or a digit of any script, goes on with the word."""
    duckdb = pytest.importorskip("duckdb")
    urls = ["http://x.org/casino", "http://x.org/casinoé", "http://x.org/écasino", "http://x.org/casino٣", "http://x.org/casino_1", "http://x.org/яfree/win", "http://x.org/free-win", "http://x.org/caf%C3%A9casino", "http://x.org/дом casino", None]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    want = {r[0]: r[1:] for r in c.sql(f"SELECT page_id, verdict, strict_hits, soft_hits FROM ({queries.ORACLE_SQL['op10_url_filter']})").fetchall()}
    got = {r["page_id"]: (r["verdict"], r["strict_hits"], r["soft_hits"]) for r in url_filter.judge(df).collect()}
    assert got == want and [got[i][0] for i in range(len(urls))] == ["block", "allow", "allow", "allow", "block", "allow", "block", "allow", "block", "allow"]

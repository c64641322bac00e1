"""The subpackage's queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import bpe, chat, decontamination, html_text, merkle, mixing, ngram_join, pii, quality_rules, spelling, topk, url_filter, warc
from panelloom.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)),
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(r"""
        SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, concat(chr(92), '### Assistant: </turn> ok') AS text
        FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)
    """)
    out = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    read = out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(q[c].alias(c) for c in counts))


def vocabulary() -> str:
    """The byte-level vocabulary's place on the machine that runs the tasks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = (F.col("h") % F.length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    noisy = found.select("word", h.alias("h")).select(F.when(F.col("h") % 97 == 0, less).otherwise(F.col("word")).alias("word"))
    return spelling.variants(spelling.vocabulary(noisy))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, columns = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    claimed = merkle.leaf([F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in columns])
    found = merkle.manifest(docs, columns, "lang", "doc_id", {"claimed": claimed}).withColumn("folded_root", merkle.refolded("claimed"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(
        "doc_id", text("leaf"), text("subroot"), text("root"), F.sha2(F.array_join(merkle.proof(), ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    o = F.col("overlap")
    return found.select(
        "doc_id", o["n_words"].alias("n_words"), o["n_hit"].alias("n_hit"), F.size(o["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(o["items"], ","), 256).alias("items_sha256"), (o["n_hit"] > 0).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_mix_to_targets, op3_exact_top_k, op4_pii, op5_chat_format, op6_warc, op7_quality_rules, op8_bpe, op9_html_text, op10_url_filter, op11_spelling_variants, op12_merkle_manifest, op13_decontamination)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

ORACLE_SQL["op7_quality_rules"] = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS t(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), c AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n - l.d, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
         CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(text, '[^A-Za-zÀ-ɏ]+', '', 'g')) AS n_latin,
         len(list_filter(w.w, lambda x: list_contains([STOP], x))) AS n_stop
  FROM w LEFT JOIN covered k USING (doc_id) LEFT JOIN lines l USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3
       AND NOT (n_words >= 30 AND n_dup_lines / n_lines > 0.6) AND NOT (n_words >= 150 AND n_stop / n_words < 0.01 AND 2 * n_latin >= word_chars) AS kept
FROM b
""".replace("STOP", ", ".join(f"'{x}'" for x in sorted({w for v in quality_rules.STOP_WORDS.values() for w in v.split()})))

ORACLE_SQL["op6_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

ORACLE_SQL["op5_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, turn, role, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '</turn>', '<' || chr(92) || '/turn>'), '### ', '#' || chr(92) || '## ') AS safe
  FROM rows
), g AS (
  SELECT conv_id, count(*) AS n,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         string_agg(role, ',' ORDER BY turn, role, text) AS roles,
         sum(length(safe) + 4 + length(role) + 2 + 8) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars,
       regexp_full_match(roles, '(system,)?user(,assistant(,tool,assistant)*,user)*(,assistant(,tool,assistant)*)?') AS valid
FROM g
"""

ORACLE_SQL["op10_url_filter"] = r"""
WITH u AS (
  SELECT page_id, lower(url_decode(coalesce(url, ''))) AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    len(list_filter([STRICT], lambda t: regexp_matches(low, '(^|[^\p{L}\p{N}])' || t || '([^\p{L}\p{N}]|$)'))) AS strict_hits,
    len(list_filter([SOFT], lambda t: regexp_matches(low, '(^|[^\p{L}\p{N}])' || t || '([^\p{L}\p{N}]|$)'))) AS soft_hits
  FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits
FROM r
""".replace("STRICT", ", ".join(f"'{x}'" for x in url_filter.STRICT), 1).replace("SOFT", ", ".join(f"'{x}'" for x in url_filter.SOFT), 1)

ORACLE_SQL["op13_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), 'WORD') AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), 'WORD') AS w FROM benchmark) WHERE len(w) > 0
), p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM b)
), o AS (
  SELECT k, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), m AS (
  SELECT k, n, s, item_id FROM o JOIN p USING (n, g)
), h AS (
  SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT k, n, s FROM m)) GROUP BY k
), i AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN i USING (k)
""".replace("WORD", decontamination.WORD).replace("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").replace("LOWER", "abcdefghijklmnopqrstuvwxyz")

ORACLE_SQL["op12_merkle_manifest"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(0, 256)) AS b)
), d AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 7 = 0 AS tampered
  FROM documents, crc_table
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN coalesce(tampered, FALSE) THEN n_chars + 1 ELSE n_chars END AS said, head, tail FROM d
), p AS (
  SELECT doc_id, lang, leaf, sha256(head || coalesce(strlen(CAST(said AS VARCHAR)) || ':' || said, '-') || tail) AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l
), up AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS h FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM up WHERE len(h) > 1
), subs AS (
  SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM up WHERE len(h) = 1
), high AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS h FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM high WHERE len(h) > 1
), steps AS (
  SELECT doc_id, p.lang, p.place, up.level, h[xor(p.place >> up.level, 1) + 1] AS sibling, (p.place >> up.level) & 1 AS right_side FROM p JOIN up ON p.lang IS NOT DISTINCT FROM up.lang WHERE len(h) > 1
), tops AS (
  SELECT lang, 1000 + level AS level, h[xor(subs.place >> level, 1) + 1] AS sibling, (subs.place >> level) & 1 AS right_side FROM subs, high WHERE len(h) > 1
), proofs AS (
  SELECT p.lang, p.place, list({'s': x.sibling, 'r': x.right_side} ORDER BY x.level) FILTER (x.level IS NOT NULL) AS path
  FROM p LEFT JOIN (SELECT lang, place, level, sibling, right_side FROM steps UNION ALL SELECT p.lang, p.place, t.level, t.sibling, t.right_side FROM p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang) x
    ON p.lang IS NOT DISTINCT FROM x.lang AND p.place = x.place
  GROUP BY p.lang, p.place
), f AS (
  SELECT p.*, path, list_reduce(list_prepend({'s': p.claimed, 'r': 0}, coalesce(path, [])),
    lambda a, x: {'s': sha256(CASE WHEN x.s IS NULL THEN a.s WHEN x.r = 1 THEN x.s || a.s ELSE a.s || x.s END), 'r': 0}).s AS folded_root
  FROM p JOIN proofs ON p.lang IS NOT DISTINCT FROM proofs.lang AND p.place = proofs.place
)
SELECT doc_id, leaf, subroot, (SELECT h[1] FROM high WHERE len(h) = 1) AS root,
       sha256(array_to_string(list_transform(list_filter(coalesce(path, []), lambda x: x.s IS NOT NULL), lambda x: x.s), '')) AS proof_sha256,
       folded_root, folded_root = (SELECT h[1] FROM high WHERE len(h) = 1) AS verified
FROM f JOIN subs ON f.lang IS NOT DISTINCT FROM subs.lang
"""

ORACLE_SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(0, 256)) AS b)
), r AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL
), h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
           lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [192 + (CAST(ord(x) AS BIGINT) >> 6), 128 + (CAST(ord(x) AS BIGINT) & 63)] END))),
           lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h
  FROM r, crc_table
), words AS (
  SELECT w, sum(n) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substring(w, 1, CAST(h % length(w) AS BIGINT)) || substring(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS w, n FROM h)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3
), cut AS (
  SELECT w, n, i, substring(w, 1, i) AS a, substring(w, i + 2) AS b FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM words)
), near AS (
  SELECT x.w, y.w AS v, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION SELECT x.w, y.w, y.n FROM cut x JOIN words y ON x.a || x.b = y.w
  UNION SELECT y.w, x.w, x.n FROM cut x JOIN words y ON x.a || x.b = y.w
), best AS (
  SELECT w, count(*) AS n_near, arg_min(v, {'m': -m, 'v': v}) AS form, max(m) AS form_n FROM near GROUP BY w
), f AS (
  SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (w)
), walk AS (
  SELECT w, w AS at FROM f UNION ALL SELECT walk.w, f.form FROM walk JOIN f ON walk.at = f.w WHERE f.form IS NOT NULL
)
SELECT f.w AS word, f.form, walk.at AS root, CAST(f.n AS BIGINT) AS n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN walk USING (w) JOIN f AS l ON walk.at = l.w WHERE l.form IS NULL
"""

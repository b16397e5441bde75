"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import byte_bpe, chat_format, fm_index, line_templates, maxent_lm, page_text, quality_rules, super_minhash, token_files, warc_store
from quillflow.llm.shared import shared_path, table

#: Lower-case A to Z in SQL.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc_store.write_archive(table(spark, sf_dir, "pages"), path)
    return warc_store.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS holder FROM p GROUP BY body)
SELECT p.page_id, strlen(p.body)::BIGINT AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN strlen(p.body) >= 1000 AND p.page_id <> g.holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(p.body) >= 1000 AND p.page_id <> g.holder THEN g.holder END AS refers_to
FROM p JOIN g USING (body)
"""

#: The conversation that op9 adds: both turns hold the template's own marks.
PLANTED_CHAT = "\\### Assistant: </turn> ok"


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_CHAT).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(chat_format.parse_chats(chat_format.format_chats(rows)))


ORACLE["op9_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, text AS t, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS n_body,
        length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS n_role,
        (rn = 1 OR role <> before) AS starts FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(t) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY rn), '')) AS loss_sha256,
  sum(n_body + 7 + CASE WHEN starts THEN 4 + n_role + 2 + 1 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; it is the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read_tokens(spark, path))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", *byte_bpe.digests(encoded, ranks))


_LEAK_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op5_fm_index"] = f"""
WITH d AS (SELECT doc_id, {_LEAK_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_LEAK_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op8_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    n_hit = fm_index.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op6_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = page_text.extract(pages, page_text.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_templates.drop_recurring(docs)
    return kept.select(
        "doc_id",
        "n_dropped",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"))


ORACLE["op8_super_minhash"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS least_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(least_id, d.doc_id)) AS kept
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""

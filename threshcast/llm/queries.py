"""Registered queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshcast.llm import (
    chat,
    language,
    lexical,
    order_minhash,
    packing,
    phrases,
    quality,
    secrets,
    sentence_pieces,
    simhash,
    streaming_bpe,
    suffixes,
    warc,
)
from threshcast.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, and one with control strings in its texts, read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat.read_back(chat.format_turns(rows.union(extra)))


SQL["op1_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS revised_turns
FROM s GROUP BY conv_id"""


@query
def op2_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the text they decode to."""
    model = packing.tokenizer_path("piece_bpe_32k.model")
    return sentence_pieces.encode_documents(table(spark, folder, "documents"), model)


@query
def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document after repeated strings of 100 bytes are cut."""
    return suffixes.digest(suffixes.cut_repeats(table(spark, folder, "documents"), window=100))


@query
def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, by pattern and by models trained on the same table."""
    docs = table(spark, folder, "documents")
    return secrets.report(docs, secrets.train(docs))


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document from text, declared language and source."""
    found = language.of_documents(table(spark, folder, "documents"))
    return found.select("doc_id", "_language.*")


@query
def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page: visible text, markup language, address suffix and host."""
    text = language.fit_text(table(spark, folder, "documents"))
    html = F.coalesce("html", F.lit(""))
    seen = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;", " ")
    marked = F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    pages = table(spark, folder, "pages").select("page_id", "url", seen.alias("text"), marked.alias("marked"))
    hints = {"declared": F.col("marked"), "address": F.col("url")}
    found = language.identify(pages, language.fit(pages, text, **hints), **hints)
    return found.select("page_id", "_language.*")


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2048 tokens."""
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, packing.tokenizer_path(), capacity=2048)


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record as written to archives and read back."""
    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, count(*) OVER (PARTITION BY payload_digest) AS n,
             max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> first THEN first END AS refers_to
FROM r"""


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    found = quality.judge(table(spark, folder, "documents"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "distance", "kept")


@query
def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Order MinHash of every document, of its edited text, and how alike they are."""
    return order_minhash.compare_edited(table(spark, folder, "documents"))


@query
def op11_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"""unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
SQL["op11_ranked_lexical_search"] = f"""
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM n, s),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM d GROUP BY term), s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY item_id, term),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN d USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
             doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10"""


@query
def op12_streaming_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    return streaming_bpe.transcode(table(spark, folder, "documents"), streaming_bpe.byte_model_path())


@query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """First 2000 phrases of two or three words of each language."""
    return phrases.collocations(table(spark, folder, "documents"))


SQL["op13_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS w
  FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, w, count(*) AS f FROM g GROUP BY lang, k, w),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, w, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.w, c.a, j, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c, (VALUES (1), (2)) AS cuts(j)
  JOIN f AS l ON l.lang = c.lang AND l.k = j AND l.w = c.w[1:j]
  JOIN f AS r ON r.lang = c.lang AND r.k = c.k - j AND r.w = c.w[j + 1:c.k]
  WHERE j < c.k),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1),
longer AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, w[1:2] AS part, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2:3], a FROM c WHERE k = 3)
  GROUP BY lang, part),
kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.part = best.w
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank,
       array_to_string(w, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000"""

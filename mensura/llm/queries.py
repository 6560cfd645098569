"""The corpus operators applied to the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import chat, html_text, licenses, pieces, warc
from mensura.llm.alignment import alignment
from mensura.llm.common import checkpoint_root, read_table
from mensura.llm.exact_dedup import exact_duplicates
from mensura.llm.fingerprints import containment, encoded, fingerprint_with_edits, resemblance
from mensura.llm.importance import fit_importance, importance_scores
from mensura.llm.minhash_join import minhash_duplicates
from mensura.llm.packing import pack
from mensura.llm.ranked_search import search
from mensura.llm.simhash import near_duplicates

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
BYTE_PAIR_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint_with_edits(read_table(spark, sf_dir, "documents"))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        encoded(own).alias("fingerprint"),
        encoded(edited).alias("edited_fingerprint"),
        resemblance(own, edited).alias("near_edited"),
        resemblance(own, after).alias("near_next"),
        containment(own, edited).alias("in_edited"),
        containment(own, after).alias("in_next"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), BYTE_PAIR_RANKS)


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_importance(documents, read_table(spark, sf_dir, "labels"))
    return importance_scores(documents, model)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/warc-{uuid4().hex}"
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder)
    return warc.resolved_records(warc.read_archives(spark, folder))


OP5_SQL = """
WITH digests AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), parts AS (
  SELECT page_id, payload,
         list_transform([1, 11, 21, 31], lambda g: ('0x' || substr(hex, g, 10))::BIGINT) AS groups
  FROM digests
)
SELECT page_id,
       strlen(payload) AS payload_bytes,
       list_aggregate(
         list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((groups[1 + i // 8] >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER same THEN NULL ELSE min(page_id) OVER same END AS refers_to,
       true AS intact
FROM parts
WINDOW same AS (PARTITION BY payload)
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    """Phrases and all pairs of text and template blocks, by plain counting."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    blocks = ", ".join(
        f"({number}, '{label}', [{', '.join(repr(w.decode()) for w in words)}])" for number, (label, words) in enumerate(licenses.template_blocks())
    )
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for label, phrase in licenses.BASE_PHRASES)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), phrases(label, phrase) AS (VALUES {phrases}),
places AS (
  SELECT row, label, unnest(range(len(words) - len(phrase) + 1)) AS place, words, phrase FROM texts, phrases
), base AS (
  SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM places WHERE words[place + 1:place + len(phrase)] = phrase GROUP BY row
), blocks AS (
  SELECT row, words[32 * b + 1:32 * b + 64] AS block FROM (SELECT row, words, unnest(range((len(words) + 31) // 32)) AS b FROM texts)
), templates(number, label, wanted) AS (VALUES {blocks}),
matched AS (
  SELECT row, list(DISTINCT label) AS labels, max(overlap / len(wanted)) AS score
  FROM (SELECT row, label, wanted, len(list_intersect(block, wanted)) AS overlap FROM blocks, templates)
  WHERE overlap >= ceil(0.8 * len(wanted) - 1e-9) GROUP BY row
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, matched.labels))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS score
FROM texts LEFT JOIN base USING (row) LEFT JOIN matched USING (row)
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(read_table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)
    return encoded.withColumn("text", pieces.decoder(SENTENCEPIECE_MODEL)("ids")).select(
        "doc_id",
        "n_chunks",
        "score",
        F.size("ids").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.length("text").alias("decoded_chars"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(planted), BYTE_PAIR_RANKS), BYTE_PAIR_RANKS).drop("n_tokens")


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), said AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1#\2', 'g'))
          + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1#\2', 'g')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + length('<|turn|><|text|><|end|>')) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


# The pages' articles hold headings and paragraphs only, and these character references.
OP10_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda p: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda p: p <> '') AS blocks
  FROM articles
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM blocks
"""


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(read_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), places AS (
  SELECT row, words, unnest(range(greatest(len(words) - 2, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END))) AS place FROM texts
), shingles AS (SELECT DISTINCT row, array_to_string(words[place + 1:place + 3], ' ') AS shingle FROM places
), sizes AS (SELECT row, count(*) AS n FROM shingles GROUP BY row
), links AS (
  SELECT x.row AS a, y.row AS b FROM shingles x JOIN shingles y USING (shingle) JOIN sizes p ON p.row = x.row JOIN sizes q ON q.row = y.row
  WHERE x.row <> y.row GROUP BY x.row, y.row, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reached AS (
  SELECT row AS a, row AS b FROM texts UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(u.doc_id) AS component_id, t.doc_id = min(u.doc_id) AS kept
FROM reached r JOIN texts t ON t.row = r.a JOIN texts u ON u.row = r.b LEFT JOIN sizes s ON s.row = r.a GROUP BY t.row, t.doc_id, s.n
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), sizes AS (SELECT row, count(*) AS n FROM words GROUP BY row
), corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes
), asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), postings AS (SELECT row, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, docs
), scored AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), corpus GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents"), BYTE_LEVEL, SENTENCEPIECE_MODEL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_scaled_sketch": op2_scaled_sketch,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_importance_resampling": op4_importance_resampling,
        "op5_warc_revisits": op5_warc_revisits,
        "op6_license_scan": op6_license_scan,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_chat_format": op8_chat_format,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_html_text": op10_html_text,
        "op11_minhash_near_dedup": op11_minhash_near_dedup,
        "op12_ranked_search": op12_ranked_search,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op5_warc_revisits": OP5_SQL,
        "op6_license_scan": _op6_sql(),
        "op8_chat_format": OP8_SQL,
        "op10_html_text": OP10_SQL,
        "op11_minhash_near_dedup": OP11_SQL,
        "op12_ranked_search": OP12_SQL,
    }

"""Registered queries of the training-data operators, and their DuckDB SQL.

Each query imports its operator when it is called, so that one broken optional library does not
take the others away.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import table


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_conversations(rows.unionByName(chat.probe_conversation(spark)))
    read = out.select(
        "conv_id",
        chat.parse_formatted(F.col("formatted")).alias("back"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("masked"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("masked"), "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
        "layout",
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(text)
    + length(regexp_extract_all(text, '[<\[]\\*(?:\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])')) + 11) AS BIGINT) AS formatted_chars,
  CASE coalesce((conv_id % 5 + 5) % 5, 0) WHEN 1 THEN CASE WHEN bool_or(role IN ('human', 'gpt')) THEN 'messages' ELSE 'conversations' END
    WHEN 2 THEN 'turns' WHEN 3 THEN 'dialog'
    WHEN 4 THEN CASE WHEN bool_or(text = '') THEN 'messages'
      WHEN string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text) = 'user assistant' THEN 'prompt_response'
      WHEN string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text) = 'system user assistant' THEN 'system_prompt_response'
      WHEN regexp_full_match(string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text), 'user assistant( user assistant)+') THEN 'prompt_history' ELSE 'messages' END
    ELSE 'messages' END AS layout
FROM rows GROUP BY conv_id
"""


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.syncmers import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, with digests of both."""
    from glossa.llm.unigram import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = encode_documents(docs.withColumn("text_sha256", F.sha2(F.encode("text", "UTF-8"), 256)), _tokenizer("piece_bpe_32k.model"), ["doc_id", "text_sha256"])
    decoded = F.sha2(F.encode("decoded", "UTF-8"), 256)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.length("decoded").cast("long").alias("n_chars"), decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("round_trip"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "byte_start")


OP9_SQL = r"""
WITH crc_table AS (
  SELECT list_reduce(list_concat([i::UBIGINT], [x::UBIGINT for x in range(8)]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v, i
  FROM range(256) r(i)
), crcs AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    CAST(xor(list_reduce(list_concat([4294967295::UBIGINT],
      [('0x' || x)::UBIGINT for x in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32
  FROM documents, crcs
), placed AS (
  SELECT *, CAST(sum(size) OVER w - size AS BIGINT) AS byte_start, row_number() OVER w - 1 AS row_start, sum(size) OVER () AS all_bytes
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), cut AS (
  SELECT *, least(15, CAST(((byte_start + size // 2) * 16) // all_bytes AS INTEGER)) AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_start - min(row_start) OVER (PARTITION BY shard) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, byte_start
FROM cut
"""


def _tokenizer(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.pfor import token_file_digest

    return token_file_digest(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.ppm import scores

    return scores(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.quality_rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM docs
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
windows AS (
  SELECT doc_id, i, word, CASE WHEN lead(word, 2) OVER p IS NULL THEN NULL ELSE word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p END AS g
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS t FROM windows),
hits AS (
  SELECT doc_id, t OR coalesce(lag(t, 1) OVER p, false) OR coalesce(lag(t, 2) OVER p, false) AS hit
  FROM twice WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM hits GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM split LEFT JOIN repeats USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length
  FROM m
), long AS (
  SELECT lang, source, x.measure AS measure, x.value AS value FROM (
    SELECT lang, source, unnest([{'measure': 'symbols', 'value': symbols}, {'measure': 'dup_lines', 'value': dup_lines}, {'measure': 'repeats', 'value': repeats},
      {'measure': 'word_length', 'value': word_length}, {'measure': 'words', 'value': n_words}, {'measure': 'lines', 'value': n_lines}]) AS x FROM v WHERE NOT base_failed)
), sketch AS (
  SELECT lang, source, measure, (value >> greatest(0, length(bin(value)) - 6)) << greatest(0, length(bin(value)) - 6) AS bucket, count(*) AS n
  FROM long GROUP BY ALL
), of_lang AS (SELECT lang, measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
run AS (
  SELECT *, sum(n) OVER g AS total, sum(n) OVER (g ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM sketch WINDOW g AS (PARTITION BY lang, source, measure)
), run_lang AS (
  SELECT *, sum(n) OVER g AS total, sum(n) OVER (g ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM of_lang WINDOW g AS (PARTITION BY lang, measure)
), q AS (
  SELECT lang, source, measure, max(total) AS total, min(bucket) FILTER (upto >= greatest(1, (25 * total + 99) // 100)) AS q25,
    min(bucket) FILTER (upto >= greatest(1, (50 * total + 99) // 100)) AS q50 FROM run GROUP BY ALL
), q_lang AS (
  SELECT lang, measure, min(bucket) FILTER (upto >= greatest(1, (25 * total + 99) // 100)) AS q25,
    min(bucket) FILTER (upto >= greatest(1, (50 * total + 99) // 100)) AS q50 FROM run_lang GROUP BY ALL
), mixed AS (
  SELECT q.lang, q.source, q.measure, q.total, (q.total * q.q25 + 100 * b.q25) // (q.total + 100) AS q25, (q.total * q.q50 + 100 * b.q50) // (q.total + 100) AS q50
  FROM q JOIN q_lang b ON q.lang IS NOT DISTINCT FROM b.lang AND q.measure = b.measure
), wide AS (
  SELECT lang, source, max(total) AS group_docs, max(q50) FILTER (measure = 'words') AS words, max(q50) FILTER (measure = 'lines') AS lines,
    max(q50) FILTER (measure = 'symbols') AS s, max(q50 - q25) FILTER (measure = 'symbols') AS ds, max(q50) FILTER (measure = 'dup_lines') AS d, max(q50 - q25) FILTER (measure = 'dup_lines') AS dd,
    max(q50) FILTER (measure = 'repeats') AS r, max(q50 - q25) FILTER (measure = 'repeats') AS dr, max(q50) FILTER (measure = 'word_length') AS w, max(q50 - q25) FILTER (measure = 'word_length') AS dw
  FROM mixed GROUP BY lang, source
), limits AS (
  SELECT lang, source, group_docs, s + 8 * greatest(ds, 1000 // greatest(1, words), 1) AS hs, d + 8 * greatest(dd, 1000 // greatest(1, lines), 1) AS hd,
    r + 16 * greatest(dr, 6000 // greatest(1, words), 1) AS hr, w + 8 * greatest(dw, w // 32, 1) AS hw, w - 8 * greatest(dw, w // 32, 1) AS lw
  FROM wide
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  NOT base_failed AND coalesce(symbols <= hs AND dup_lines <= hd AND repeats <= hr AND word_length BETWEEN lw AND hw, true) AS kept,
  CAST(coalesce(group_docs, 0) AS BIGINT) AS group_docs
FROM v LEFT JOIN limits ON v.lang IS NOT DISTINCT FROM limits.lang AND v.source IS NOT DISTINCT FROM limits.source
"""


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n_words=4, max_bits=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sharding": op9_sharding,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}
ORACLES: dict[str, str] = {"op5_quality_rules": OP5_SQL, "op6_chat_formatting": OP6_SQL, "op9_sharding": OP9_SQL}

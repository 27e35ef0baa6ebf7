"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import alignment, chat, chunk_dedup, collocations, hamming_search, licenses, mixing, packing, pii, quality, simhash, suffix_match, toxicity
from corvane.llm.common import keep, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; null and empty texts score 0, and a null doc_id is never held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences; each row of a repeated doc_id has pieces of its own, a null text the end id."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero and link like others."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null texts have size 0, null sources are one source, the last."""
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ten of each hundredth vector among all; null vectors have code 0, as no element of theirs is over zero."""
    codes = keep(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_search.sign_code(F.col("embedding")).alias("code")))
    return hamming_search.top_k(codes.where("id % 100 = 0"), codes)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_substring_dedup": chunk_dedup.op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_pii_sanitise": pii.op4_pii_sanitise,
    "op5_packing": op5_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_mixing": op8_mixing,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_chat_format": chat.op10_chat_format,
    "op11_collocations": collocations.op11_collocations,
    "op12_alignment": alignment.op12_alignment,
    "op13_decontamination": suffix_match.op13_decontamination,
}

_OP8 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goals),
tries AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, floor(r.rate) AS whole, s.seed,
         (('0x' || substr(md5(concat(s.seed, ':', coalesce(d.doc_id::VARCHAR, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate))::INT AS more
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN range({mixing.SEEDS}) s(seed)),
best AS (
  SELECT source, arg_min(seed, (miss, seed)) AS seed FROM (
    SELECT source, seed, abs(any_value(whole) * any_value(source_size) + sum(more * size) - any_value(target)) AS miss FROM tries GROUP BY source, seed) GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (whole + more))::BIGINT AS taken
FROM tries t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.seed = b.seed
"""

_OP9 = """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id,
         list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: ((p[1] > 0) <> (p[2] > 0))::INT))::INTEGER AS distance
  FROM q, embeddings e)
SELECT query_id, id, distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs) WHERE rank <= 10
"""

_OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
written AS (
  SELECT *, CASE WHEN text LIKE '%<|im_start|>%' OR text LIKE '%<|im_end|>%' OR text LIKE '%\%25%' ESCAPE '\' OR text LIKE '%\%3C%' ESCAPE '\' OR text LIKE '%\%0A%' ESCAPE '\'
                 THEN replace(replace(text, '%', '%25'), '<', '%3C') ELSE text END AS safe FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || safe || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE, "op8_mixing": _OP8, "op9_exact_top_k": _OP9, "op10_chat_format": _OP10,
    "op11_collocations": collocations.ORACLE, "op13_decontamination": suffix_match.ORACLE,
}

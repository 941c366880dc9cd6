"""The queries of the corpus operators, opN_<name>, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchway.llm import embedding_forest, jaccard, line_dedup, log_bilinear, packing, piece_codec, quality, token_counts, toxicity, warc
from larchway.llm.common import read

#: Documents of more tokens than this are marked by op2.
TOKEN_LIMIT = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids: a row for each piece, with the checksum of its ids."""
    pieces = packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each whole document."""
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with equal labels and a cosine of 0.98 or more."""
    return embedding_forest.near_vectors(read(spark, sf_dir, "embeddings"), least=0.98)


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all whole documents under the smoothed unigram base and the log-bilinear model."""
    return log_bilinear.score_texts(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all whole documents, learned from the labelled rows that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of all pages, with the ids they refer to, source headers and digests."""
    out = warc.derivatives(read(spark, sf_dir, "pages"), responses=False)
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_headers", "content_type", "block_digest", "payload_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier line equals, or comes within one word of."""
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS line_no, ls[i] AS line, list_filter(regexp_split_to_array(ls[i], '[ 	-
]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), long AS (SELECT *, len(ws) AS n FROM l WHERE len(ws) >= 1
), c AS (SELECT ws, n, min((doc_id, line_no)) AS first FROM long GROUP BY ws, n
), near AS (
  SELECT DISTINCT a.ws FROM c a JOIN c b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first
  WHERE a.n >= 8 AND b.n >= 8 AND (a.ws[1:4] = b.ws[1:4] OR a.ws[-4:] = b.ws[-4:]) AND CASE
    WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda k: a.ws[k] <> b.ws[k])) = 1
    WHEN a.n > b.n THEN len(list_filter(range(1, a.n + 1), lambda k: list_concat(a.ws[1:k - 1], a.ws[k + 1:]) = b.ws)) > 0
    ELSE len(list_filter(range(1, b.n + 1), lambda k: list_concat(b.ws[1:k - 1], b.ws[k + 1:]) = a.ws)) > 0 END
), gone AS (
  SELECT g.doc_id, g.line_no FROM long g JOIN c ON g.ws = c.ws WHERE c.first < (g.doc_id, g.line_no) OR g.ws IN (SELECT ws FROM near)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM kept
"""


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the newest policy."""
    out = quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(quality.mask_of("base"))) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_twin_words", "n_upper", "failed")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents
), lines AS (
  SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM w
), g AS (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), twins AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w) WHERE ws[i] = ws[i + 1] GROUP BY doc_id
), m AS (
  SELECT l.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines, coalesce(tw.n, 0)::BIGINT AS n_twin_words,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]', '', 'g'))::BIGINT AS n_upper
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id LEFT JOIN twins tw ON l.doc_id = tw.doc_id
), f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines)::BIGINT
    + 64 * (2 * n_upper > word_chars)::BIGINT + 128 * (5 * n_twin_words > n_words)::BIGINT)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
  n_lines, n_twin_words, n_upper, failed
FROM f
"""


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the ids and of the decoded text of each whole document."""
    coded = piece_codec.encode_and_decode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), size=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_token_counts": op2_token_counts,
        "op3_embedding_forest": op3_embedding_forest,
        "op4_log_bilinear": op4_log_bilinear,
        "op5_toxicity": op5_toxicity,
        "op6_warc_derivatives": op6_warc_derivatives,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_ledger": op8_quality_ledger,
        "op9_piece_codec": op9_piece_codec,
        "op10_jaccard": op10_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op8_quality_ledger": OP8_SQL}

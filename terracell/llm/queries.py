"""The operators applied to the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, tokenization
from .alignment import align_tokenizers
from .common import fold, table
from .decontamination import decontaminate
from .divergence import source_divergence
from .log_templates import drop_recurring_lines
from .near_duplicates import near_duplicates
from .packing import pack
from .perspectives import rotate_perspectives
from .quality_rules import quality_rules
from .sharding import shard_by_bytes
from .url_templates import url_verdicts


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A production vocabulary, from the package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, cut=False, with_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, size, list_aggregate(words[k : k + size - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT item, words, least(10, len(words)) AS size,
               unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k
        FROM item_words WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT row, size, k, list_aggregate(words[k : k + size - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS k
        FROM doc_words, sizes WHERE len(words) >= size)
), hits AS (
  SELECT row, k, size, item FROM places JOIN windows USING (size, phrase)
), hit_words AS (
  SELECT row, count(*) AS n_hit
  FROM (SELECT DISTINCT row, unnest(range(k, k + size)) AS w FROM hits) GROUP BY row
), hit_items AS (
  SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
"""


def op2_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), split_words AS (
  SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), windows AS (
  SELECT row, k, list_aggregate(words[k : k + 7], 'string_agg', ' ') AS phrase
  FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS k FROM split_words WHERE len(words) >= 8)
), repeats AS (
  SELECT row, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT row, unnest(range(k, k + 8)) AS w
        FROM (SELECT row, k, count(*) OVER (PARTITION BY row, phrase) AS n FROM windows) WHERE n > 1)
  GROUP BY row
), lines AS (
  SELECT row, host, text, line, length(translate(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '')) AS chars,
         trim(regexp_replace(regexp_replace(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'),
           '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT row, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)
), word_lines AS (
  SELECT * FROM lines WHERE chars > 0
), dups AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM word_lines GROUP BY row
), hosts AS (
  SELECT host, count(DISTINCT text) AS host_docs FROM docs GROUP BY host
), line_docs AS (
  SELECT host, norm, count(DISTINCT text) AS n FROM word_lines GROUP BY host, norm HAVING count(DISTINCT text) > 20
), frequent AS (
  SELECT l.host, norm FROM line_docs l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host WHERE 100 * n > host_docs
), removed AS (
  SELECT row, sum(chars) AS removed_chars
  FROM word_lines l JOIN frequent f ON l.norm = f.norm AND l.host IS NOT DISTINCT FROM f.host GROUP BY row
), counts AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(CAST(removed_chars AS BIGINT), 0) AS removed_chars
  FROM docs JOIN split_words USING (row) LEFT JOIN repeats USING (row) LEFT JOIN dups USING (row) LEFT JOIN removed USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed_chars <= 0.5 * word_chars AS kept, removed_chars
FROM counts
"""


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    """Learned from labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 1)
    return quality.fit(table(spark, sf_dir, "documents"), labels)


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out(), "score", "predicted")


def op4_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(fold(F.col("doc_id")) != 1))
    return language_id.identify(docs, model).select("doc_id", held_out(), "lang_pred", "score")


def held_out():
    return F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")


#: fixed values: verdict, host, path
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op5_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=80)


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = rotate_perspectives(table(spark, sf_dir, "conversations"))
    masks = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return views.withColumn("masks", F.array_join(masks, ","))


OP10_SQL = """
WITH turns AS (
  SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER w - 1 AS pos
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST)
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), segments AS (
  SELECT t.conv_id, speaker, CAST(pos // 256 AS INTEGER) AS part, pos, coalesce(role = speaker, false) AS own,
         '<|start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user ' || replace(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10), ' ') END || chr(10) AS head,
         replace(text, '<|', '< |') || '<|end|>' AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos) - 1 AS stop
  FROM segments
)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY pos) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, speaker, part
"""


def op11_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    found = tokenization.decode(tokenization.encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=10, top_terms=10)


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents
), places AS (
  SELECT row, lang, source, unnest(words) AS term FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), langs AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM places JOIN kept k USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY lang, source
), prices AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
         1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)
       LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM prices WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return align_tokenizers(table(spark, sf_dir, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fm_index_decontamination,
        op2_line_frequency_rules,
        op3_compression_quality,
        op4_cross_parsing_language,
        op5_path_templates,
        op6_harmonic_packing,
        op7_byte_shards,
        op8_log_templates,
        op9_parity_sketch_join,
        op10_perspective_rotation,
        op11_tokenization_automaton,
        op12_source_divergence,
        op13_tokenizer_alignment,
    )
}

ORACLES: dict[str, str] = {"op1_fm_index_decontamination": OP1_SQL, "op2_line_frequency_rules": OP2_SQL, "op10_perspective_rotation": OP10_SQL, "op12_source_divergence": OP12_SQL}

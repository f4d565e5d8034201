"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .chat import digest_conversations, format_conversations
from .common import table, word_count, written
from .divergence import source_divergence
from .flac import MEDIA_OPTIONS, digest_blocks, encode_media, pcm_blocks
from .line_dedup import dedup_lines
from .minhash import minhash_near_duplicates
from .packing import pack_documents
from .periodic import periodic_runs
from .quality_model import fit_quality, score_quality
from .quality_rules import quality_rules
from .secrets import scan_secrets, span_text
from .simhash import near_duplicates
from .token_store import new_store, store_index

DOC = ["doc_id", "text"]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select(*DOC))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
  SELECT *, length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))
          + length(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 23 AS size
  FROM turns
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) s
),
repeated AS (
  SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.keep AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clusters = near_duplicates(docs.select(*DOC)).filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("cluster"))
    rows = docs.select("doc_id", "source", word_count("text").alias("n_words")).join(clusters, "doc_id", "left")
    return pack_documents(rows, "n_words")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select(*DOC))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), count(3).alias("n_entropy")
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select(*DOC))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select(*DOC)).drop("text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOC)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).drop("text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = table(spark, sf_dir, "documents").select("doc_id", bpe_encode("text", path).alias("ids"))
    decoded = encoded.withColumn("decoded", bpe_decode("ids", path))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_store(table(spark, sf_dir, "documents").select(*DOC), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return store_index(spark, path)


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(encode_media(table(spark, sf_dir, "documents").select(*DOC)).drop("text"), "media", **MEDIA_OPTIONS)
    stored = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return digest_blocks(pcm_blocks(stored, "doc_id", "media", keep=("n_bytes", "media_bytes", "media_sha256")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    blocks = written(format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")), "formatted")
    return digest_conversations(blocks)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document; of every tenth or so, the words from one on repeat a stretch of them."""
    docs = table(spark, sf_dir, "documents").select(*DOC)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    docs = docs.withColumns({"_g": F.floor(F.col("_h") / 10), "_n": F.size("_words")}).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    docs = docs.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", place(i))), " ")
    planted = docs.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    named = found.withColumn("_best", best).withColumns({"start": -F.col("_best.start"), "length": F.col("_best.length"), "period": -F.col("_best.period")})
    return named.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *("start", "length", "period"),
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_duplicates(table(spark, sf_dir, "documents").select(*DOC))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, sum(n) + count(*) AS total FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
sums AS (SELECT lang, source, sum(n) + count(*) AS total FROM cells GROUP BY lang, source),
shares AS (
  SELECT c.lang, c.source, c.term, c.n,
         1 + (CAST(1000000000 AS HUGEINT) * (c.n + 1)) // s.total AS p, 1 + (CAST(1000000000 AS HUGEINT) * (c.lang_n + 1)) // l.total AS lang_p
  FROM cells c JOIN sums s ON c.lang = s.lang AND c.source = s.source JOIN langs l ON c.lang = l.lang
),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - lang_p) * (p - lang_p)) // lang_p FROM shares WHERE n > 0 AND p > lang_p
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_store": op5_token_store,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_format": op7_chat_format,
    "op8_bpe": op8_bpe,
    "op9_flac_media": op9_flac_media,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op7_chat_format": OP7_SQL, "op13_source_divergence": OP13_SQL}

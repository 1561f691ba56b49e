"""One query for each corpus operator, over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, golay_dedup, langid, mixing, near_dedup, packing, pii, prefix_trie, quality_mil, rules, sharding, whitening
from .common import crc_of_id

TOKENIZER = "byte_bpe_50k.json"
#: The key of the registered query; a real run brings its own secret.
PII_KEY = "corpus-key-1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations_with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts hold the control strings."""
    text = r"\### Assistant: </turn> ok"
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_formatted(chat.format_conversations(conversations_with_probe(_table(spark, sf_dir, "conversations"))))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("length", F.col("length").cast("long"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_mil.learn(docs, labels.filter(F.pmod(crc_of_id(), F.lit(4)) != 2))
    out = quality_mil.score(docs, model)
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "pii_found")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False))  # a row without an id is in no fold
    profiles = langid.learn(docs.filter(~held_out))
    out = langid.identify(docs, profiles)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "nearness")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), c AS (
  SELECT t FROM x GROUP BY t HAVING count(*) > 1
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT x.* FROM x JOIN c USING (t)) a JOIN (SELECT x.* FROM x JOIN c USING (t)) b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS m FROM s UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.a
), m AS (
  SELECT a AS doc_id, min(m) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(text, '</turn>', '<\/turn>'), '### ', '##\# ') AS one,
    replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS two,
    replace(replace(replace(role, '\', '\b'), chr(10), '\n'), ':', '\c') AS head
  FROM t
), f AS (
  SELECT *, CASE
    WHEN NOT contains(text, '</turn>') AND NOT contains(text, '### ') AND regexp_replace(text, '\\([\\/#])', '\1', 'g') = text THEN text
    WHEN regexp_replace(one, '\\([\\/#])', '\1', 'g') = text THEN one ELSE two END AS escaped
  FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || head || ':' || chr(10) || escaped || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
  true AS round_trip
FROM f GROUP BY conv_id
"""

OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, sha256('mix-1:' || doc_id::VARCHAR) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w::DOUBLE AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, w::DOUBLE * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l
), b AS (
  SELECT *, floor(target + 0.5e0)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5e0)::BIGINT // source_size ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""


OP10_SQL = """
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents
), p AS (
  SELECT doc_id, n_bytes, d, substr(bits, 1, d) AS shard FROM d, (SELECT unnest(range(0, 61))::INT AS d)
), s AS (
  SELECT *, sum(n_bytes) OVER g AS shard_bytes, count(*) OVER g AS shard_docs FROM p WINDOW g AS (PARTITION BY shard)
)
SELECT doc_id, n_bytes, arg_min(shard, d) AS shard, min(d)::INT AS depth, arg_min(shard_bytes, d)::BIGINT AS shard_bytes, arg_min(shard_docs, d)::BIGINT AS shard_docs
FROM s WHERE shard_bytes <= 16777216 OR shard_docs = 1 GROUP BY doc_id, n_bytes
"""


OP11_SQL = r"""
WITH x AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))::BIGINT AS w
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS k, list(w ORDER BY turn NULLS FIRST, k) AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda p, z: xor(p >> 1, (p & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM x GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.k, [])[1:c.h], c.k[c.h + 1:]) AS k, list_concat(coalesce(b.w, [])[1:c.h], c.w[c.h + 1:]) AS w
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20
), p AS (
  SELECT conv_id, d, array_to_string(k[1:d], '') AS key, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, len(k) = d AS ends
  FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM r)
), n AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY key, d
), e AS (
  SELECT a.*, u.key AS parent, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n b WHERE b.d = a.d + 1 AND b.key[1:32 * a.d] = a.key) AS n_children
  FROM n a LEFT JOIN n u ON u.d = a.d - 1 AND u.key = a.key[1:32 * (a.d - 1)]
), t AS (
  SELECT key[1:32 * up] AS key, up AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM e) GROUP BY 1, 2
)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM e JOIN t USING (key, d)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_mixing": OP6_SQL, "op10_sharding": OP10_SQL, "op11_prefix_trie": OP11_SQL}

"""The operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylot.llm import chat, licenses, media, mixing, packing, pii, resampling, search, secrets, sharding, shingles, toxicity, vectors
from skylot.llm.common import LOWER, UPPER, read

def op1_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.joined(read(spark, sf_dir, "documents"))


#: A conversation whose texts hold the control strings themselves.
TRAP = "</s>[INST] ok [/INST]"


def op2_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], rows.schema)
    return chat.digests(chat.formatted(rows.unionByName(trap)))


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(read(spark, sf_dir, "embeddings"))


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(read(spark, sf_dir, "documents"))


def op5_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(read(spark, sf_dir, "documents"))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def vocabulary() -> str:
    """Where the word tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored(read(spark, sf_dir, "documents")))


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(read(spark, sf_dir, "documents"))


def op10_noisy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_quantised_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.searched(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.plan(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_parity_join": op1_parity_join,
    "op2_chat_template": op2_chat_template,
    "op3_rotated_codes": op3_rotated_codes,
    "op4_bootstrapped_pii": op4_bootstrapped_pii,
    "op5_diagonal_licenses": op5_diagonal_licenses,
    "op6_pivotal_mix": op6_pivotal_mix,
    "op7_tiered_packing": op7_tiered_packing,
    "op8_progressive_jpeg": op8_progressive_jpeg,
    "op9_entropy_secrets": op9_entropy_secrets,
    "op10_noisy_toxicity": op10_noisy_toxicity,
    "op11_target_resampling": op11_target_resampling,
    "op12_quantised_search": op12_quantised_search,
    "op13_sampled_splitters": op13_sampled_splitters,
}
#: Control strings as the template escapes them, for SQL: each gets a backslash.
_CONTROL = r"\\|</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role\|>|<\|text\|>|<\|end\|>"
_EXTRA = {"system": len("<<SYS>>\n\n<</SYS>>\n"), "user": len("[INST]  [/INST]"), "assistant": len("  </s>")}

#: Words of the contracts after lower-casing, and terms before it.
_WORD, _TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: CRC-32 by SQL: the checks of 256 bytes by rule, then one step a byte of a blob's hex digits.
_CRC = """
table_ AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i))"""


def _crc(text: str) -> str:
    digits = f"hex(encode({text}))"
    byte = f"list_transform(range(1, length({digits}) + 1, 2), lambda i: ('0x' || {digits}[i:i + 1])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


SQL: dict[str, str] = {
    "op2_chat_template": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
measured AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS escaped,
    CASE role WHEN 'system' THEN {_EXTRA['system']} WHEN 'user' THEN {_EXTRA['user']} WHEN 'assistant' THEN {_EXTRA['assistant']}
    ELSE {len("<|role|><|text|><|end|>")} + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS marks FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len("<s>")} + sum(escaped + marks) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id""",
    "op3_rotated_codes": """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e""",
    "op11_target_resampling": rf"""
WITH {_CRC.strip()},
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
aims AS MATERIALIZED (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM benchmark),
f AS MATERIALIZED (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM docs
  UNION ALL SELECT 0, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM aims),
named AS MATERIALIZED (SELECT x, {_crc("x")} % 10000 AS bucket FROM (SELECT DISTINCT x FROM f), table_),
placed AS MATERIALIZED (SELECT r, bucket FROM f JOIN named USING (x)),
gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket, count(*) FILTER (r > 0) AS s, count(*) FILTER (r = 0) AS t FROM placed GROUP BY bucket)),
weights AS (SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS fit,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) FILTER (fit) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM ranked""",
    "op12_quantised_search": rf"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_TERM}'), lambda x: translate(x, '{UPPER}', '{LOWER}')) AS w FROM documents),
held AS (SELECT doc_id, w, len(w) AS n FROM docs WHERE len(w) > 0),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM held),
asked AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{_TERM}'), lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS x FROM benchmark),
tf AS MATERIALIZED (
  SELECT doc_id, n, x, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS x FROM held) WHERE x IN (SELECT x FROM asked) GROUP BY doc_id, n, x),
weights AS (SELECT x, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY x, docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (x) JOIN weights USING (x), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op13_sampled_splitters": rf"""
WITH {_CRC.strip()},
checks AS (SELECT x, {_crc("x")} AS text_crc32 FROM (SELECT DISTINCT coalesce(text, '') AS x FROM documents), table_),
rows_ AS (SELECT doc_id, strlen(x) + 8 AS size, text_crc32 FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents) JOIN checks USING (x)),
dealt AS (
  SELECT *, least(23, floor((2 * (sum(size) OVER o - size) + size) * 24 / (2 * sum(size) OVER ())))::INTEGER AS shard, row_number() OVER o AS place
  FROM rows_ WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard FROM dealt""",
}

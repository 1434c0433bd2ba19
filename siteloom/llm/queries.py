"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, exact_dedup, minhash_dedup, mixing, quality, sentencepiece_lattice, sharding, substring_dedup, warc
from .common import table

N_SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat_format.digest(chat_format.format_conversations(convs.union(own)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup_digest(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3 what SQL can say: each source's size and target."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select(F.col("source"), mixing.n_words("text").alias("size"))
    return mixing.source_targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    "op2_sentencepiece": op2_sentencepiece,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op3_mixing": op3_mixing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op1_sharding": op1_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op10_warc": op10_warc,
    "mixing_targets": mixing_targets,
}

OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

# Constants are spelled out, so that a wrong one in the operator shows: the multiplier of the walk in two halves, 64 buckets.
# The checksum goes by half bytes, with the 16 values of the polynomial 0xEDB88320; the walk of the hash is a recursive table.
OP1_SQL = f"""
WITH RECURSIVE crc16 AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(16) r(i))
), bytes AS (
  SELECT doc_id, text, list_transform(string_split(hex(encode(text)), ''), lambda c: strpos('0123456789ABCDEF', c)::BIGINT - 1) AS h FROM documents
), sums AS (
  SELECT doc_id, CASE WHEN text IS NOT NULL THEN xor(4294967295, CASE WHEN text = '' THEN 4294967295 ELSE list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(h)), lambda k: h[(k // 2) * 2 + 2 - k % 2])),
    lambda c, x: xor(c >> 4, tab[(xor(c, x) & 15) + 1])) END) END AS text_crc32,
    coalesce(octet_length(encode(text)), 0)::BIGINT + 16 AS size FROM bytes, crc16
), walk AS (
  SELECT doc_id, 0 AS step, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k, 0::BIGINT AS j, 0::BIGINT AS b, 0::BIGINT AS g, 0::BIGINT AS bucket FROM documents
  UNION ALL
  SELECT doc_id, step + 1, k2, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT,
    CASE WHEN j < {N_SHARDS} THEN j ELSE b END, j, CASE WHEN step = 0 THEN ((k2 // 8589934592) % 64)::BIGINT ELSE bucket END
  FROM (SELECT *, ((k * 666578662 % 4294967296) * 4294967296 + k * 2276503805 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j <= {N_SHARDS})
), ended AS (SELECT doc_id, b AS shard, g AS grown, bucket FROM walk WHERE j > {N_SHARDS})
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32) - 1 AS slot, grown::INT AS grown_shard
FROM ended JOIN sums USING (doc_id)
"""


# Fixed values of the template, spelled out likewise.
_MARK, _TEXT_SIGNS = "␛", [("<|", "a"), ("<s>", "b"), ("</s>", "c"), ("[INST]", "d"), ("[/INST]", "e"), ("<<SYS>>", "f"), ("<</SYS>>", "g")]
_NEXT, _AROUND = len("<|next|>"), len("<|start|>") + 1 + len("<|end|>") + 1


def _sql_escaped(text: str, pairs: list[tuple[str, str]]) -> str:
    out = f"replace({text}, '{_MARK}', '{_MARK}z')"
    for what, letter in pairs:
        out = f"replace({out}, {'chr(10)' if what == chr(10) else repr(what)}, '{_MARK}{letter}')"
    return out


OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
), n AS (
  SELECT *, length({_sql_escaped("text", _TEXT_SIGNS)}) + CASE WHEN before = role THEN {_NEXT} ELSE {_AROUND} + length({_sql_escaped("role", [*_TEXT_SIGNS, (chr(10), "n")])}) END AS chars FROM m
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM q
"""

# Words as op5 and op7 take them.
_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)"

OP5_SQL = f"""
WITH {_WORDS}, windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(l) - 18), lambda i: md5(array_to_string(l[i:i + 19], ' ')))) AS h, unnest(range(1, len(l) - 18)) AS p FROM w WHERE len(l) >= 20
), ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM ranked WHERE r > 1),
words AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

_CLASSES = "both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reached(node, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.root FROM reached r JOIN both_ways e ON e.a = r.node)"

OP7_SQL = f"""
WITH RECURSIVE {_WORDS}, s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) ELSE [array_to_string(l, ' ')] END)) AS g FROM w WHERE len(l) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8::DOUBLE * (x.n + y.n - m)),
nodes AS (SELECT doc_id AS id FROM documents), {_CLASSES}
SELECT node AS doc_id, min(root) AS class_id, node = min(root) AS kept FROM reached GROUP BY node
"""

OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), good AS (
  SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95::DOUBLE),
nodes AS (SELECT vec_id AS id FROM v), {_CLASSES}, n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT node AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(root) AS component_id, node = min(root) AS kept FROM reached LEFT JOIN n ON n.a = node GROUP BY node
"""

# Sources fill up in the order of what they may take at most by weight, until the level of those left is below.
MIXING_TARGETS_SQL = r"""
WITH p AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::DOUBLE AS size FROM documents GROUP BY source),
w AS (SELECT source, size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM p),
f AS (SELECT *, coalesce(sum(2 * size) OVER before, 0) AS full_size, coalesce(sum(weight) OVER before, 0) AS full_weight, sum(size) OVER () * 1.5 AS total, sum(weight) OVER () AS weights
  FROM w WINDOW before AS (ORDER BY 2 * size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - full_size) / (weights - full_weight) AS level FROM f),
one AS (SELECT arg_min(level, 2 * size / weight) AS level FROM g WHERE level * weight < 2 * size)
SELECT source, size::BIGINT AS source_size, round(coalesce(least(one.level * weight, 2 * size), 2 * size), 3) AS target FROM g, one
"""

ORACLES = {"op1_sharding": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op8_chat_formatting": OP8_SQL, "op10_warc": OP10_SQL, "op5_substring_dedup": OP5_SQL, "op7_minhash_near_dedup": OP7_SQL, "op9_embedding_near_dedup": OP9_SQL, "mixing_targets": MIXING_TARGETS_SQL}

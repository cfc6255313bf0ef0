"""The query of each operator over its whole table, and its SQL twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    got = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
    response = F.col("record_type") == "response"
    return got.select(
        number("record_id").alias("page_id"), F.when(response, F.col("n")).otherwise(F.col("stated")).alias("payload_bytes"),
        F.when(response, F.col("sha1")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four parts, a half, a quarter and two eighths; all are merged and read by the last manifest."""
    from .scratch import Scratch
    from .sharding import ShardStore

    docs = _documents(spark, sf_dir)
    store = ShardStore(spark, Scratch(spark, "shards").path, docs.schema)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for low, high in ((0, 4), (4, 6), (6, 7), (7, 8)):
        store.append(docs.filter((part >= low) & (part < high)))
    store.compact(least=2, older_than=0)  # no one else reads this store
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


SQL_OP2 = "SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS text_sha256 FROM documents"


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import near_groups

    return near_groups(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import audio_features, store_audio

    found = audio_features(store_audio(_documents(spark, sf_dir)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "loud")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


SQL_OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_ids import read_token_ids, write_token_ids

    return read_token_ids(write_token_ids(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm_nbest import encode_n_best

    return encode_n_best(_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import listed, merged, scan

    found = scan(_documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed("base"), 256).alias("base_sha256"),
        listed(merged("base", "added")).alias("spans"),
    )


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """Fitted on at most quality.MAX_ROWS labelled rows of which none is held out, those whose id hashes lowest."""
    from . import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = labels.filter(labels.quality.isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    learn = learn.select("doc_id", F.col("quality").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(quality.MAX_ROWS)
    return quality.train(docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id"))  # no more than MAX_ROWS small rows


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _documents(spark, sf_dir)
    out = quality.score(docs, quality_model(spark, sf_dir, docs), keep=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: The answer to a group of equal payloads is its least page_id; a payload's SHA-1 is written in base 32, five hex digits
#: as four letters.
SQL_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hexed, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
n AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hexed, CAST(5 * k + 1 AS INT), 5))::BIGINT) AS parts FROM d)
SELECT page_id, payload_bytes,
    array_to_string(flatten(list_transform(parts, lambda x: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INT) + 1, 1)))), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM n
"""

#: Sets of shingles as lists, links of documents by an exact count of common ones, and the least id reachable.
SQL_OP3 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS class, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
grams AS (SELECT class, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.class AS x, b.class AS y FROM grams a JOIN grams b ON a.g = b.g AND a.class < b.class AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
    GROUP BY a.class, b.class HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT class AS x, class AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x AS class, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
FROM s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN least USING (class)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_sharding, op3_ngram_jaccard, op4_audio, op5_exact_dedup, op6_best_fit_packing, op7_token_ids, op8_sentencepiece, op9_secret_scan, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": SQL_OP1, "op2_sharding": SQL_OP2, "op3_ngram_jaccard": SQL_OP3, "op5_exact_dedup": SQL_OP5}

"""The operators of this subpackage as queries over the given tables, with oracle text where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotloom.llm import bpe, chat, decontam, langid, linededup, mtree, negatives, pii, quality, repair, shards, simhash, tokenscan
from spotloom.llm.common import read
from spotloom.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(read(spark, sf_dir, "documents"), *tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate_lines(read(spark, sf_dir, "documents"), "chunks_removed").select("doc_id", "chunks_removed", "text")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


ORACLES["op2_topk"] = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS other, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON c.uid <> q.uid AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = pii.find(docs, pii.learn(docs))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenscan.with_place(read(spark, sf_dir, "documents").select("doc_id", "text"))
    folder = scratch_path(spark, "tokens")
    tokenscan.write_token_files(docs, folder, *tokenizer(), split_by=("file_hash", "file_block"), order_by="file_row")
    counts = tokenscan.in_file(tokenscan.count_tokens(spark, folder))
    # Ids come from a scan of its own: the number of a row in its file is the same however either scan was cut.
    return counts.join(docs.select("doc_id", "file_hash", "file_row"), ["file_hash", "file_row"]).select("doc_id", "n_tokens")


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    # One turn in four loses its marker, so that the model has roles to recover.
    shown = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) != 0
    rows = chat.transcripts(turns, shown)
    return chat.parse(rows, chat.learn(rows))


@query
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(read(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=wrong)


ORACLES["op12_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS uid, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.uid, a.vec_id AS anchor_id, c.vec_id, c.uid AS other, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
    FROM v a JOIN v c ON c.uid <> a.uid AND len(c.e) = len(a.e) WHERE a.vec_id % 100 = 0
), p AS (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) AS n FROM s WHERE same
), n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.uid, p.n ORDER BY s.score DESC, s.vec_id, s.other) AS rank
    FROM p JOIN s ON s.uid = p.uid WHERE p.n <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), harm.alias("harm"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))})
    return repair.summaries(repair.repair(rows, F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)))

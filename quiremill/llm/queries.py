"""The queries opN_<name>: thin forms of the operators, on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import bpe, chunks, langid, lines, mixing, mpeg, neardup, neighbours, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), word_bpe_path())


def op2_digests(docs: DataFrame) -> DataFrame:
    done = bpe.encode(docs, word_bpe_path(), decode=True)
    return done.select("doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_digests(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.filter(langid.learners()))
    return langid.identify(docs.select("doc_id", "text"), profiles).select("doc_id", (~langid.learners()).alias("held_out"), "lang_pred", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.usable(table(spark, sf_dir, "embeddings"))
    return neighbours.search(rows, rows.filter("vec_id % 20 = 0"), neighbours.fit(rows), 20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.filter(toxicity.learners()))
    return toxicity.score(docs.select("doc_id", "text"), index).select("doc_id", (~toxicity.learners()).alias("held_out"), "score", "predicted")


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    stored = mpeg.to_audio(docs.select(F.struct("doc_id", size.alias("n_bytes")).alias("doc_id"), mpeg.padded(F.col("text")).alias("payload")))
    read = mpeg.read_audio(stored)
    seconds = F.concat_ws(
        ";", F.lit("mpeg1-layer3"), F.concat(F.lit("hz="), "rate"), F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("us="), "duration_us"), F.concat(F.lit("bad="), F.col("bad_checksums") + F.col("resyncs")), F.concat(F.lit("seek="), F.substring(F.md5(F.concat_ws(",", F.col("offsets").cast("array<string>"))), 1, 16))
    )
    return read.select(
        "doc_id.doc_id",
        "doc_id.n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        seconds.alias("feature"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("size", mixing.word_count(F.col("text"))).select("doc_id", "source", "text", "size")
    done = mixing.with_copies(docs)
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_near_dedup": op8_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op8_near_dedup": neardup.ORACLE_SQL,
    "op9_line_dedup": lines.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
}

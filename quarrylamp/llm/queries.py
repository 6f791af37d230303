"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylamp.llm import (
    bytebpe, classifier, kdsearch, licences, linededup, mixing, negatives, packing, ppm, simhash, suffixdedup, votes,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """An installed vocabulary; the packing query counts in the first one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=1, capacity=4096)


def op2_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier."""
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), length=100).drop("kept")


def op3_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    scored = classifier.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return ppm.scores(table(spark, sf_dir, "documents"))


def op5_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts, votes and verdicts of all documents."""
    return votes.quality(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences in all documents."""
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", simhash.hex_print(F.col("print")).alias("fingerprint"), "component_id")


def op8_kdsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every 50th vector among all others."""
    vectors = kdsearch.whole_vectors(table(spark, sf_dir, "embeddings"))
    return kdsearch.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their recurring lines."""
    return linededup.deduped(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", "text"
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every 100th vector."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.whole_vectors(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return negatives.mine(vectors, vectors.filter("vec_id % 100 = 0"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened to 32 components."""
    return whitening.whiten(whitening.whole_numbers(table(spark, sf_dir, "embeddings")), components=32)


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), path)
    return bytebpe.digests(bytebpe.decode(encoded, path))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffixdedup": op2_suffixdedup,
    "op3_classifier": op3_classifier,
    "op4_ppm": op4_ppm,
    "op5_votes": op5_votes,
    "op6_licences": op6_licences,
    "op7_simhash": op7_simhash,
    "op8_kdsearch": op8_kdsearch,
    "op9_mixing": op9_mixing,
    "op10_linededup": op10_linededup,
    "op11_negatives": op11_negatives,
    "op12_whitening": op12_whitening,
    "op13_bytebpe": op13_bytebpe,
}

"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from licspark.llm.bestfit import best_fit_packing
from licspark.llm.boosted_quality import score_quality, train_quality
from licspark.llm.factorization import score_toxicity, train_toxicity
from licspark.llm.hard_negatives import hard_negatives
from licspark.llm.host_suffixes import extract_main_text
from licspark.llm.imatch import edit_probe
from licspark.llm.language_bayes import predict_languages, train_languages
from licspark.llm.ngram_jaccard import ngram_jaccard_classes
from licspark.llm.piece_codec import decode_pieces, encode_pieces
from licspark.llm.prefix_trie import conversation_paths, prefix_trie, rejoined
from licspark.llm.quality_rules import quality_rules
from licspark.llm.shard_packing import shard_documents
from licspark.llm.token_frames import token_frames

#: The id that ends a document in the token files.
END_ID = 2


def _tokenizer(name: str) -> str:
    """Path of a public tokenizer's file on this and every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(_table(spark, sf_dir, "documents")).drop("set_id", "group_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def _remainder(divisor: int):
    """crc32 of the doc_id as text, modulo `divisor`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op3_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def _scored(spark: SparkSession, sf_dir: str, train, score) -> DataFrame:
    """Fit on labels outside the held-out fifth, score all documents."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = train(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, train_quality, score_quality)


def op5_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = train_languages(docs.where(~held_out))
    return predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(_table(spark, sf_dir, "documents"))


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = token_frames(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), END_ID)
    return frames.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, train_toxicity, score_toxicity)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _tokenizer("piece_bpe_32k.model")
    coded = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents"), model), model)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op11_lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", changed), F.col("vec_id") % 100 == 0)


def op12_bestfit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = conversation_paths(_table(spark, sf_dir, "conversations"))
    return prefix_trie(rejoined(paths, 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality_rules": op2_quality_rules,
    "op3_host_suffixes": op3_host_suffixes,
    "op4_boosted_quality": op4_boosted_quality,
    "op5_language_bayes": op5_language_bayes,
    "op6_imatch": op6_imatch,
    "op7_token_frames": op7_token_frames,
    "op8_factorization": op8_factorization,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_bestfit": op10_bestfit,
    "op11_lemp_negatives": op11_lemp_negatives,
    "op12_bestfit_shards": op12_bestfit_shards,
    "op13_prefix_trie": op13_prefix_trie,
}

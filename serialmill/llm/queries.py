"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialmill.llm import ann, bpe, langid, packing, piecebpe, pii, quality, resample, simjoin, tokenbin, toxicity, veccode, warc
from serialmill.llm.common import id_bucket, table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failure_bits").bitwiseAND(F.lit(quality.BASE_BITS)) != 0).alias("base_failed"), "kept", "failure_bits",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(id_bucket("doc_id", 5) != 0)
    model = toxicity.fit(docs.join(labels, "doc_id"))
    out = toxicity.score(docs, model)
    spans = F.array_join(F.transform("toxic_spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    held_out = F.coalesce(id_bucket("doc_id", 5), F.lit(1)) == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_toxic_spans"), spans.alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(id_bucket("doc_id", 4) != 2))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (F.coalesce(id_bucket("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(docs, pii.fit(docs))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.audit(stored, warc.rotten(stored)).select("page_id", "status", "length", "expected_sha256")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("class_key", "row_key")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe_path())


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe_path())


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_bpe_path())


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccode.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("n_evaluated")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_warc_audit": op7_warc_audit,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_token_binary": op4_token_binary,
    "op5_toxicity": op5_toxicity,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_piece_round_trip": op11_piece_round_trip,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL = {
    "op6_nearest_neighbours": ann.ORACLE,
    "op7_warc_audit": warc.ORACLE,
    "op3_ngram_jaccard_join": simjoin.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op12_importance_resampling": resample.ORACLE,
    "op13_vector_codes": veccode.oracle(),
}

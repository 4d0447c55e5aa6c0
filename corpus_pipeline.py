"""The corpus pipeline: language ID, quality rules, near-duplicate removal, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's result as Parquet in the shared folder and reads it again as the
next stage's input, so a lost executor repeats one stage at most.

Every stage reads whole texts of any length and takes an empty table to an empty one. Rows that are repeated are
judged alike. Columns beyond those of ``documents`` are not carried on, and their names may clash with anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialmill.llm import langid, packing, pii, quality, simjoin
from serialmill.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: On sf0.1 (model of its first 2,400 rows) a least score of 0.55 rejects 4 of 3,409 good documents; texts of fewer words are too short to tell.
LEAST_SCORE, LEAST_WORDS = 0.55, 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or with a null or empty text) go, and those that no known language claims: whose best score is low.
    Where no row has a language to learn from, all documents with a letter stay. Null ids, languages and sources stay as they are;
    of languages with equal scores the first by name counts, which changes no score."""
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    out = langid.predict(docs, model, out="_lang", score="_score")
    short = F.size(quality.words(F.col("text"))) < LEAST_WORDS
    return out.where((F.col("_lang") != langid.UNKNOWN) & ((F.col("_score") >= LEAST_SCORE) | short)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of policy v1 go. A null or empty text has too few words; no other column is looked at."""
    return quality.apply_policy(quality.ledger(docs), "v1", "_kept").where("_kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: one with the smallest id (null ids last; of rows with equal ids that with the smallest hash).
    Rows that agree in id and text are one: the least by language, source and n_chars, nulls first. Documents without words, null texts among them, all stay."""
    classes = simjoin.near_duplicates(docs.select("doc_id", "text"))
    first = classes.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("m"))
    keyed = docs.select(*COLUMNS, simjoin.row_key("doc_id", "text").alias("_key"), F.size(quality.words(F.col("text"))).alias("_words"))
    kept = keyed.where("_words > 0").join(first.select(F.col("m.row_key").alias("_key")), "_key", "left_semi")
    kept = kept.groupBy("_key", "_words").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("r")).select("r.*", "_words")
    return kept.select(*COLUMNS, "_words").unionByName(keyed.where("_words = 0").drop("_key")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind, overlapping ones by that of the first; n_chars follows the text. Null texts stay null."""
    out = pii.detect(docs, pii.fit(docs), out="_spans", masked="_masked")
    return out.select("doc_id", F.col("_masked").alias("text"), "lang", "source", F.length("_masked").cast("bigint").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document has its place in a bin. Null and empty texts have no row; null sources conflict with nothing; pieces of
    equal length are taken by id, then place."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, and a greedy search over an order, have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

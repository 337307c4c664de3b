"""Corpus pipeline: language identification, exact copies, near copies, mixture of sources, packing.

Each stage works on all rows its predecessor kept and returns the columns of documents, but for the last, which returns the
packed pieces. Every stage's result is written as Parquet in the shared folder and read again as the next one's documents.

Null and empty texts have no language and go in the first stage; a null identifier or source is a value like others; rows that
are repeated become one in the second; ties go to the smallest identifier; texts are read whole at any length; columns beside
those of documents pass through, under whatever name; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratolens.llm.common import fresh, stored
from stratolens.llm.exact_dedup import exact_dedup
from stratolens.llm.language_id import predict_language, train
from stratolens.llm.mixing import mix_sources
from stratolens.llm.ngram_join import near_duplicates
from stratolens.llm.packing import pack_sequences

#: A text whose best language has a lower pooled probability is rejected; so are texts without a letter.
LANG_SCORE = 0.35
#: Near copies: words in a shingle and the least similarity in hundredths.
WORDS, PERCENT = 5, 80


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts no language is likely for; a language that isn't known becomes the predicted one."""
    lang, score = fresh(docs, "lang_pred", "score")
    found = predict_language(docs, train(docs)).filter((F.col(lang) != "und") & (F.col(score) >= LANG_SCORE))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    kept = fresh(docs, "keep_id", "group_size", "kept")[2]
    return exact_dedup(docs, carry=docs.columns, sized=False).filter(F.col(kept)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest identifier of each component of linked texts; texts without words link with nothing and stay."""
    found = near_duplicates(docs, n=WORDS, percent=PERCENT, links=False).filter("component is not null")
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = found.join(first, "component").filter(row != F.col("first")).select(F.col("doc_id").alias("gone_doc"), F.col("text_hash").alias("gone_hash"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_doc")) & (F.xxhash64(docs["text"]) == F.col("gone_hash")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as often as the mix takes it, whole: a part of at least half counts as once more. A text is there up to three times."""
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mix_sources(docs).filter("taken > 0").groupBy(F.col("doc_id").alias("mix_doc"), F.col("digest").alias("mix_hash")).agg(F.max(copies).alias("mix_copies"))
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("mix_doc")) & (F.xxhash64(docs["text"]) == F.col("mix_hash")))
    return rows.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in bins of permitted lengths."""
    return pack_sequences(docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]
#: A recurrent network and best-fit packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""A corpus pipeline of five stages, each a thin call of one operator of ``millrace.llm``.

Each stage is written as Parquet and read again before the next, in the shared
folder that ``spark.checkpoint.dir`` names. All but the last return the columns
of their input documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, mixing, neardup, pieces, secrets
from millrace.session import mark, materialise, sweep, table

#: A text whose cosine with its language's prototype is below this resembles no learned language: the cosine of
#: unlike texts has a deviation of 1 / sqrt(DIM), and this is three of them. Only asked of texts with enough letters.
LEAST_SCORE, ENOUGH = 3 / language.DIM**0.5, 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts, texts without a letter and texts like no language go.

    A text of fewer than ``ENOUGH`` letters is too short to tell, so it stays if it has a letter. ``lang`` becomes the language that was found, null ones included: later stages work by it.
    """
    lang, score, letters = added = ("__lang", "__score", "__letters")
    found = language.identify(docs, added=added)
    known = found.where((F.col(lang) != language.UNKNOWN) & ((F.col(letters) < ENOUGH) | (F.col(score) >= LEAST_SCORE)))
    return known.withColumn("lang", F.col(lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id.

    Rows that repeat a doc_id are one document: of the kept one's rows, one stays
    (the first by its columns). Rows with a null doc_id take no part in the classes;
    one of each text stays.
    """
    known = docs.where("doc_id IS NOT NULL")
    found = neardup.near_duplicates(known.select("doc_id", "text"))
    first = found.where("doc_id = class_id").select("doc_id").distinct()
    # the first by the columns that have an order; maps have none
    ordered = F.struct(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    whole = lambda *without: F.min_by(F.struct(*[c for c in docs.columns if c not in without]), ordered).alias("__row")
    kept = known.join(first, "doc_id", "left_semi")
    # only doc_ids that are repeated go through an aggregation; texts of the others stay where they are
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    alone = kept.join(repeated, "doc_id", "left_anti")
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(whole("doc_id")).select("doc_id", "__row.*")
    unnamed = docs.where("doc_id IS NULL").groupBy("text").agg(whole("text")).select("text", "__row.*")
    out = alone.select(*docs.columns)
    for more in (again, unnamed):
        out = out.unionByName(more.select(*docs.columns))
    return out


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redacted(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have flattened shares of the tokens."""
    return mixing.sample(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids of each document."""
    ids = pieces.encode_documents(docs, keep=("lang", "source"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: No stage but the fourth can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; when a stage is written, the tables before it are removed."""
    docs, begun = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        sweep(spark, docs, since=begun)
    return STAGES[-1][1](spark, docs, sf_dir)

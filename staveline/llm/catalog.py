"""Queries ``opN_<name>`` of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staveline.llm import chat, oracles, toxicity
from staveline.llm.decontamination import overlaps
from staveline.llm.html_main import extract
from staveline.llm.minhash import near_duplicates
from staveline.llm.packing import pack
from staveline.llm.pii import personal_data
from staveline.llm.subspace import near_vectors
from staveline.llm.tables import table, vocabulary
from staveline.llm.url_templates import judge_urls, path_of
from staveline.llm.warc import round_trip


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_run=True)


#: Fixed value: from this score on a document is predicted to be toxic.
TOXIC_AT = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False))
    predicted = (F.col("score") >= TOXIC_AT).cast("int")
    rows = toxicity.scored(docs, machine)
    return rows.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, per_cent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are told to the model for the conversations outside the held-out third only."""
    told = chat.as_transcript(table(spark, sf_dir, "conversations"))
    roles = told.filter(toxicity.fold(F.col("conv_id")) != 1).select("conv_id", "turn", "role")
    return chat.parse(told.select("conv_id", "turn", "text"), roles)


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: The rules of the query, as (verdict, host, path start).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as bad if the document whose number ends its path is labelled as of low quality."""
    number = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1), '') as bigint)")
    bad = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("number")).agg((F.min("quality") == 0).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", path_of(F.col("url")).alias("path"))
    pages = pages.withColumn("number", number).join(bad, "number", "left").select("page_id", "url", "bad")
    return judge_urls(pages, URL_RULES).withColumn("purity", F.round("purity", 9))


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii": op1_pii,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_html": op5_html,
        "op6_minhash": op6_minhash,
        "op7_warc": op7_warc,
        "op8_chat": op8_chat,
        "op9_embeddings": op9_embeddings,
        "op10_urls": op10_urls,
    }


def oracle_sql() -> dict:
    sql = {"op6_minhash": oracles.MINHASH, "op7_warc": oracles.WARC, "op9_embeddings": oracles.EMBEDDINGS, "op10_urls": oracles.url_templates(URL_RULES)}
    return sql if corpus_pipeline.ORACLE_SQL is None else sql | {"pipeline": corpus_pipeline.ORACLE_SQL}

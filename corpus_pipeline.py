"""Corpus pipeline: documents pass five stages, each written and read again.

Language ID drops documents without a language, toxicity those judged toxic,
MinHash near-dedup keeps one document of each group (the smallest id), secret
scans replace secrets by a mark, packing places what is left into batches.

Stages take (spark, docs, sf_dir) and return the columns of ``docs``; the last
adds token counts and places.  Documents with a null or letterless text go at
the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common, langid, minhash, packing, secrets, tokencount, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found; ``lang`` stays as it was."""
    model = langid.fit(docs.where(~common.held_out()))
    return langid.identified(docs, model).where(F.col("lang_pred") != langid.UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are not judged toxic."""
    labels = common.table(spark, sf_dir, "labels").where(~common.held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs, model).where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates; of rows that
    repeat an id and its text one stays, and rows without an id all do."""
    kept = minhash.near_duplicates(docs, size=5).where("kept").select("doc_id").distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    rows = docs.join(kept, "doc_id", "left_semi")
    out = rows.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.unionByName(docs.where("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; ``n_chars`` follows the new text."""
    found = secrets.scanned(docs, secrets.fit(docs))
    text = secrets.redacted(F.col("text"), F.col("secret_spans"))
    changed = F.size("secret_spans") > 0
    new = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and place of every document."""
    return packing.packed(tokencount.with_tokens(docs, keep=["doc_id"]), "n_tokens", "doc_id")


STAGES = [("language_id", language), ("toxicity", civil), ("near_dedup", distinct), ("secrets", clean), ("packing", packed)]

#: Cross-parsing, the CRF and MinHash cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        common.dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``docs``.

Empty tables pass through every stage; null and empty texts are scored, kept and sharded like others; columns beside
doc_id, text and source are carried along whatever their names. Stages decide by a row's doc_id,
text and source together, so rows whose doc_id is null or repeated are judged by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.flow_mixing import mix_sources
from panelwright.llm.fm_decontaminate import find_contamination
from panelwright.llm.fm_quality import ACCEPT, quality_fold, score_quality, train_quality
from panelwright.llm.hilbert_shards import hilbert_shards
from panelwright.llm.parity_join import jaccard_components
from panelwright.llm.store import settle
from panelwright.llm.words import free_name

#: A number column that the classifier reads where the documents have it.
META = "n_chars"


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (a score of ACCEPT or more); labels are joined by doc_id for learning only."""
    meta = (META,) if META in docs.columns else ()
    machine = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality_fold(), meta_cols=meta)
    score = free_name(docs, "_score")
    scored = score_quality(docs, machine, meta_cols=meta, score_col=score)
    return scored.filter(F.col(score) >= ACCEPT).select(docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that rows share only where doc_id, text and source are equal, ordered by doc_id, nulls last."""
    name = free_name(docs, "_key")
    prints = F.xxhash64("text", "source").alias("a"), F.xxhash64(F.lit(1), "source", "text").alias("b")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *prints)
    return docs.withColumn(name, key), name


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that similarity >= 0.8 links; one of repeated rows. Rows
    without words or doc_id repeat nothing."""
    fed, key = keyed(docs)
    groups = jaccard_components(fed, id_col=key)
    kept = groups.filter(F.col(key) == F.col("component_id")).select(key)
    out = fed.join(kept.distinct(), key, "left_semi")
    again = groups.groupBy(key).count().filter("count > 1").limit(1)
    if not again.isEmpty():
        alone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        out = out.filter(~alone).dropDuplicates([key]).unionByName(out.filter(alone))
    return out.select(docs.columns)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("spans") == 0).select("row.*")


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, one or two rows. Rows that are equal in doc_id, text and
    source are kept alike, as often as they are taken on average."""
    times = free_name(docs, "_times")
    fed, key = keyed(docs)
    taken = mix_sources(fed, F.array("source"), key_col=key).filter("size > 0")
    taken = taken.groupBy(key).agg(F.round(F.sum(F.col("taken") / F.col("size")) / F.count("*")).cast("int").alias(times)).filter(F.col(times) > 0)
    out = fed.join(taken, key)
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def shards(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, curve index, shard and slot of every row."""
    return hilbert_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("shards", shards)]
#: The first stage fits a model, which is not SQL; tests/llm holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed sequences: five stages, each an operator of lodestone.llm on all that the one before kept.

All stages but the last return the columns of documents. Cases: an empty table passes through every stage; null texts
count as empty; further columns may have any names; rows that repeat are kept or dropped by the operators' own rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import linededup, mixing, packing, simhash, toxicity
from lodestone.llm.common import columns_of, fresh, if_small, stored
from lodestone.llm.queries import TOKENIZER
from lodestone.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go."""
    model = toxicity.fit(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(model, spark, F.col("text").cast("string")) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line go; a document of which only blanks would stay goes, unless it was blank before."""
    found, kept, gone, _ = linededup.dedup(docs)
    text = {"text": F.col(kept), "n_chars": F.when(F.col(gone).isNull(), found["n_chars"]).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))}
    empty = F.col(gone).isNotNull() & ~F.rlike(F.coalesce(kept, F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    return found.where(~empty).select(*[text[c].alias(c) if c in text else column for c, column in zip(docs.columns, columns_of(found))])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that a similarity of 0.8 of five-word shingles links the one of the smallest doc_id stays; of rows with one doc_id, one. Rows without a doc_id stay."""
    found = stored(simhash.similar_documents(docs), "near-duplicates").where("doc_id is not null")
    gone = found.where("doc_id > component_id").select("doc_id").distinct()
    repeated = stored(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return docs.join(if_small(gone), "doc_id", "left_anti").select(*columns_of(docs))
    once = docs.join(if_small(gone.unionByName(repeated).distinct()), "doc_id", "left_anti")
    first = docs.join(if_small(repeated.join(gone, "doc_id", "left_anti")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.select(*columns_of(docs)).unionByName(first.select(*columns_of(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its words taken, rounded to whole documents (none, once or twice)."""
    placed, taken, _ = mixing.mix(docs)
    id_, times_, copy_ = fresh(docs, "id", "times", "copy")
    times = placed.join(taken.groupBy("uid").agg(F.sum("words").alias("taken")), "uid", "left")
    times = times.select(F.col("doc_id").alias(id_), F.when(F.col("size") > 0, F.round(F.coalesce("taken", F.lit(0)) / F.col("size"))).otherwise(F.lit(1)).cast("int").alias(times_))
    times = if_small(times.groupBy(id_).agg(F.max(times_).alias(times_)).where(F.col(times_) > 0))
    found = docs.join(times, docs["doc_id"].eqNullSafe(times[id_]))
    return found.select(*columns_of(docs), F.explode(F.array_repeat(F.lit(1), times[times_])).alias(copy_)).drop(copy_)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place there."""
    return packing.report(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(ship(spark), docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs

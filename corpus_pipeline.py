"""A corpus from raw documents to packed sequences: toxic documents go, one of each near-duplicate group stays, sources
are mixed to target weights, and what is left is packed. Each stage reads the table that the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import mixing, packing, tjoin, toxicity
from nearfold.llm.common import scratch_path

#: Removed ids up to this count (a few megabytes) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; rows held out from learning are scored like all others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    names = ("_toxicity_score", "_toxicity_predicted")
    return toxicity.score(docs, model, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, of its smallest doc_id; one of exactly repeated rows without words; every row without a doc_id."""
    from nearfold.llm.common import written

    found = written(tjoin.classed(docs), "groups")
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    # a repeated doc_id may have several texts, each with a group of its own: its rows stay or go by the class of their text
    repeated = small(written(repeated, "repeated"))
    once = docs.join(repeated, "doc_id", "left_anti").join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    many = docs.join(repeated, "doc_id", "left_semi").withColumn("_dedup_ref", F.arrow_udf(tjoin.refs, "long")("text"))
    own = found.join(repeated, "doc_id", "left_semi")
    stay = own.where("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id", "component").agg(F.min("ref").alias("_dedup_ref")).select("doc_id", "_dedup_ref")
    first = many.join(stay, ["doc_id", "_dedup_ref"], "left_semi").groupBy("doc_id", "_dedup_ref").agg(F.min_by(F.struct(*docs.columns), "text").alias("_dedup_row"))
    wordless = many.join(own.where("n_shingles = 0").select("doc_id", F.col("ref").alias("_dedup_ref")).distinct(), ["doc_id", "_dedup_ref"], "left_semi")
    return once.union(first.select("_dedup_row.*")).union(wordless.dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a new order."""
    return mixing.replicate(docs, prefix="_mixing_out_").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_documents)]
#: A trained classifier, a similarity join and a greedy packing: SQL can't express them; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

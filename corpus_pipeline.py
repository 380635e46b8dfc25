"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last
return the columns of ``documents``:

1. toxicity: documents that the classifier rejects, by their language's threshold, go;
2. line dedup: boilerplate lines of a source go from the texts, and ``n_chars`` is counted anew;
3. near-dedup: one document of each group of near copies stays (five-word shingles, 80 percent);
4. decontamination: documents with a passage of the benchmark go;
5. packing: the token pieces of the rest and their places in sequences.

Cases: null texts and languages pass the filters; rows of one doc_id are one document from stage 3
on, of which the row with the least text stays; rows without a doc_id always stay; extra columns pass through, whatever
their names; an empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm import decontaminate, line_dedup, near_dedup, packing, queries, toxicity
from trajectra.llm.columns import give_back, protect
from trajectra.llm.store import materialize

#: Up to so many ids that go are broadcast, after they have been counted; beyond, the anti-join shuffles.
BROADCAST_IDS = 500_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't in ``gone``, which is materialized."""
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = protect(docs, ("doc_id", "text", "lang"))
    scored = toxicity.score_documents(own, _table(spark, sf_dir, "labels"), training=_table(spark, sf_dir, "documents"))
    return give_back(scored.where(~F.col("rejected")), names, docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = protect(docs, ("doc_id", "text", "source"))
    cleaned = give_back(line_dedup.dedup_lines(own), names, docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(near_dedup.near_duplicates(docs, shingle=5, similarity=80).select("doc_id", "kept"), "near-copies")
    stay = _without(docs, materialize(found.where(~F.col("kept")).select("doc_id").distinct(), "copies"))
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return stay
    several = materialize(repeated.select("doc_id"), "repeated-ids")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = stay.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")
    return _without(stay, several).unionByName(least)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, materialize(found.where("contaminated").select("doc_id").distinct(), "contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, **queries.tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Training, near-duplicate components and packing have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Documents made ready for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet below the shared folder and reads it again for the next one. All
but the last return the columns they got. Nothing but the stages' own decisions
removes a row: low quality, a near copy of a kept document, contamination.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from rankforge.llm import decontaminate, near_dedup, pieces, pii, quality
from rankforge.llm.queries import MODEL_PATH
from rankforge.llm.store import Scratch

#: Rows of an Arrow batch: texts of 10,000 rows take up to 64 MB outside the heap and again in the worker.
BATCH_ROWS = 2000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage):
    """The stage in a session whose Arrow batches have at most ``BATCH_ROWS`` rows, which the session keeps."""

    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        rows = int(spark.conf.get(BATCH_CONF))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(BATCH_CONF, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def keep_quality(spark, docs, sf_dir):
    """Documents that the quality scorer accepts."""
    return quality.classify(docs).filter("kept").select("row.*")


@small_batches
def keep_one_of_each_group(spark, docs, sf_dir):
    """The document of the smallest doc_id of each group of near duplicates.

    Rows that repeat an id with the same text count as one document; rows
    without an id are kept as they are.
    """
    found = near_dedup.near_duplicates(docs).filter("kept and doc_id is not null").groupBy("doc_id").count()
    once = docs.join(found.filter("count = 1").select("doc_id"), "doc_id", "left_semi")
    repeated = docs.join(found.filter("count > 1").select("doc_id"), "doc_id", "left_semi")
    kept = once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.filter("doc_id is null")).select(docs.columns)


@small_batches
def keep_uncontaminated(spark, docs, sf_dir):
    """Documents without, or with less than a twentieth of, benchmark passages."""
    return decontaminate.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def redact_personal_data(spark, docs, sf_dir):
    """Texts with personal data replaced by its kind; n_chars counts the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@small_batches
def sample_pieces(spark, docs, sf_dir):
    """Sampled segmentations of each text, one row per document."""
    made = pieces.encode(docs, MODEL_PATH)
    return made.select(
        "row.*",
        F.size("samples").alias("n_samples"),
        F.transform("samples", lambda s: s["ids"]).alias("ids"),
        F.transform("samples", lambda s: s["log_prob"]).alias("log_probs"),
        F.transform("samples", lambda s: s["inclusion"]).alias("inclusions"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", keep_uncontaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", sample_pieces),
]

#: The stages have no SQL form; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tmp = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = tmp.write(stage(spark, docs, sf_dir), name)
    return docs

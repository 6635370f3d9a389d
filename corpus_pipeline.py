"""The corpus pipeline: five stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``docs``. A stage sees what its predecessor kept, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.llm.byte_bpe import encode_texts
from cuewright.llm.decontaminate import find_items
from cuewright.llm.ngram_jaccard import jaccard_components
from cuewright.llm.scratch import stored
from cuewright.llm.secret_scan import scan_secrets
from cuewright.llm.toxicity import fit_toxicity, score_toxicity

#: Documents of at least this probability of the toxic class go.
TOXIC = 0.3
#: Ids that are broadcast; more are joined by shuffles.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those of the ids."""
    ids = stored(ids.select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifier, fitted on the labelled ones, takes for toxic."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # a column of the documents that is called like the score stands aside meanwhile
    spare = next(name for k in range(1, 99) if (name := "_" * k + "score") not in docs.columns)
    kept = score_toxicity(docs.withColumnRenamed("score", spare), model).where(F.col("score") < TOXIC).drop("score")
    return kept.withColumnRenamed(spare, "score").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component under five-word shingles and a similarity of 0.8; a repeated row once.

    Rows without an id have no component and stay; rows of one id and other texts stay or go together.
    """
    found = jaccard_components(docs, width=5, percent=80)
    found = stored(found.select("doc_id", "component_id"), "components")
    kept = _without(docs, found.where("doc_id <> component_id"))
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    often = kept.join(again, "doc_id", "left_semi").dropDuplicates()
    return kept.join(again, "doc_id", "left_anti").unionByName(often).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return _without(docs, find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by marks; documents stay."""
    import public_tokenizers

    clean = scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), redact=True)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text under the byte-level vocabulary, beside the other columns."""
    import public_tokenizers

    encoded = encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the encoder: tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

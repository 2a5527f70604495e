"""A training corpus in five stages, each on all that the one before it kept.

Nulls: a null or empty text scores as one without matches, links with nothing, holds no personal data, and leaves at
the mixture, which takes words; so do texts of white space. A null doc_id is never a near duplicate; a null source is a
source of its own. Repeated rows: of rows alike in doc_id and text one stays at the n-gram join. Columns beyond those of
documents are dropped by the first stage. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import curriculum, partenum, personal, sampling, toxicity
from arrears.operators.common import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores at 0.5 or more go; null texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs.select(*COLUMNS), model).filter("toxicity < 0.5").drop("toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 or more on five-word shingles the one with the smallest id stays.

    Rows that share an id are judged each by its own text; texts without words stay.
    """
    return partenum.deduplicated(docs.select(*COLUMNS))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in it is replaced, its length follows."""
    return personal.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the curriculum takes them, in training order; texts without words are never taken."""
    return curriculum.mix(docs.select(*COLUMNS), carry=COLUMNS)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with their scores."""
    return sampling.encode(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("personal_data", redact_personal),
          ("mixing", mix_sources), ("sentencepiece", sample_pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for position, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = stage(docs)
    return docs

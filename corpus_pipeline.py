"""The corpus pipeline: documents -> no toxic ones -> one of each group of near copies -> none that
overlap with benchmarks -> mixed to source weights -> packed token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

Rows with null texts, null ids or repeated ids go through every stage as the operators define it:
null texts are clean and overlap with nothing; rows with a null id are never joined as near copies;
of rows that repeat an id, one stays after the near-copy stage; a text without words is played by
no slot of the mix and so ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetmill.llm.common import scratch, table
from facetmill.llm.decontaminate import decontaminated
from facetmill.llm.jaccard_join import without_near_copies
from facetmill.llm.mixing import mixed_documents
from facetmill.llm.token_pack import packed_digest
from facetmill.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labelled ones, scores below 0.5."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity of 0.8 or more over five-word shingles."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item, up to replaced words."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source plays them."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed token files of the mix, as their documents' digests."""
    import public_tokenizers

    return packed_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: SQL can express neither the network nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        (out := stage(spark, docs, sf_dir)).write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""A training corpus from documents: the stages in order, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.bpe import encoded
from tessella.llm.common import Scratch, table
from tessella.llm.decontaminate import without_benchmark
from tessella.llm.quality import resampled
from tessella.llm.secrets import redacted
from tessella.llm.simhash import keep_one_of_each

STAGES = [
    ("quality classifier", resampled),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", redacted),
    ("BPE encoding and decoding", encoded),
]
#: No SQL: the classifier's draw and the vocabulary's merges are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again for the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.split()[0])
    return docs

"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents; ``run`` writes each result as Parquet under the shared checkpoint folder and
reads it again for the next stage, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from slotbook.llm import decontaminate, mixing, near_dedup, quality_classifier, substring_dedup
from slotbook.session import scratch_path


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, _read(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate component stays."""
    return near_dedup.one_each(docs)


def substrings(spark, docs, sf_dir):
    """Passages that an earlier document holds are cut out."""
    return substring_dedup.deduplicated(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminated(docs, _read(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """Documents the mix takes, with their rate and number of copies."""
    return mixing.mixed(docs, mixing.source_labels(docs))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("decontamination", decontamination),
    ("source mixing", source_mix),
]

#: Trained models and iterative fits are not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs

"""The driver tables as the engine's tables: documents, messages, windows, feedback and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source time of the first document, epoch milliseconds, and the distance between two.
EPOCH_MS, STEP_MS = 1_700_000_000_000, 60_000


class Tables:
    """Lazy readers over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def evidence(self) -> DataFrame:
        """documents as versioned evidence: project is the source, session the language."""
        return self.documents.select(
            F.col("doc_id").alias("document_id"), F.lit(1).alias("version"), F.col("source").alias("project"), F.col("lang").alias("session_id"),
            F.element_at(F.array(*[F.lit(k) for k in ("turn", "tool-result", "decision-candidate", "manual")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"),
            (F.lit(EPOCH_MS) + F.col("doc_id") * STEP_MS).alias("created_at"), "text",
        )

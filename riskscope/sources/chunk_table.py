"""The chunk table: text chunks with vectors, partitioned by project."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskscope.schemas import CHUNKS_SCHEMA
from riskscope.session import materialise

MAX_VECTOR_SIZE = 16_000


def check_vector_size(size: object) -> int:
    """The vector size when it is an integer in 1..16000."""
    if isinstance(size, bool) or not isinstance(size, int) or not 1 <= size <= MAX_VECTOR_SIZE:
        raise ValueError(f"vector size must be an integer in 1..{MAX_VECTOR_SIZE}, got {size!r}")
    return size


def vector_violations(chunks: DataFrame, size: int, embedding: str = "embedding") -> DataFrame:
    """Chunks whose vector does not have exactly `size` elements."""
    return chunks.where(F.size(embedding) != check_vector_size(size))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class ChunkTable:
    """Chunks in a catalogue table; each project is one partition.

    Replacing a project rewrites its partition only. The commit is one Spark job; readers
    that must never see the swap read `versioned_chunks.VersionedChunks` instead.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({CHUNKS_SCHEMA}) USING parquet PARTITIONED BY (project_id)"
        )

    @property
    def columns(self) -> list[str]:
        return self.spark.table(self.name).columns

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def replace_project(self, project_id: str, chunks: DataFrame) -> None:
        """Replace all chunks of a project; an empty frame just deletes the project.

        The rows are computed once, into the shared folder. They are rebalanced rather than
        hashed by project, so a large project is written by many tasks.
        """
        rows = materialise(chunks.withColumn("project_id", F.lit(project_id)).select(*self.columns))
        if rows.isEmpty():
            self.drop_project(project_id)
            return
        # The partition is named in the statement, so no session setting can widen what it overwrites.
        view = f"rows_{uuid.uuid4().hex}"
        rows.drop("project_id").hint("rebalance").createTempView(view)
        try:
            columns = ", ".join(c for c in self.columns if c != "project_id")
            partition = f"PARTITION (project_id = {_literal(project_id)})"
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} {partition} SELECT {columns} FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)

    def append(self, chunks: DataFrame) -> None:
        """Add rows of any projects, all in one job."""
        chunks.select(*self.columns).hint("rebalance").write.mode("append").insertInto(self.name)

    def drop_project(self, project_id: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (project_id = {_literal(project_id)})")

    def projects(self) -> DataFrame:
        return list_projects(self.read())

    def stats(self) -> DataFrame:
        return project_stats(self.read())


def list_projects(chunks: DataFrame) -> DataFrame:
    return chunks.select("project_id").distinct().orderBy("project_id")


def project_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks"))

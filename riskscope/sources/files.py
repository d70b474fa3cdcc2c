"""Source files, class facts, examples, feature tables and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from riskscope.scaling import checked_position
from riskscope.schemas import CLASS_FACTS_SCHEMA, EXAMPLES_SCHEMA, FEATURES_SCHEMA

# Directories that are never scanned.
SKIPPED_DIRECTORIES = [
    "vendor",
    ".git",
    "var",
    "node_modules",
    "Tests",
    "tests",
    "Spec",
    "spec",
    "Fixtures",
    "fixtures",
]
CONTROLLER_DIRECTORIES = ["Controller", "Action"]
CONTROLLER_SUFFIXES = ["Controller.php", "Action.php"]

# Scanned folders and the category each one feeds.
FOLDER_CATEGORIES = {
    "Controller": "controllers",
    "Entity": "entitys",
    "Service": "services",
    "Services": "services",
    "Repository": "repositorys",
    "Command": "commands",
    "Form": "forms",
    "Security": "securitys",
}


def read_source_files(spark: SparkSession, root: str, pattern: str = "*.php") -> DataFrame:
    """(path, content bytes) of the files under `root`, listed and read by Spark."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "content")
    )


def select_controllers(files: DataFrame, path: str = "path") -> DataFrame:
    """Controller and action files outside the skipped directories, each path once."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    name = F.element_at(F.split(path, "/"), -1)
    by_name = name.endswith(CONTROLLER_SUFFIXES[0]) | name.endswith(CONTROLLER_SUFFIXES[1])
    in_folder = F.arrays_overlap(folders, F.array(*map(F.lit, CONTROLLER_DIRECTORIES)))
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRECTORIES)))
    return files.where(
        F.col(path).endswith(".php") & (by_name | in_folder) & ~skipped
    ).dropDuplicates([path])


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, Latin-1 otherwise."""
    return F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))


def path_category(path: Column) -> Column:
    """Category of a path below `src/<folder>/`; null for any other path."""
    mapping = F.create_map(*[F.lit(x) for pair in FOLDER_CATEGORIES.items() for x in pair])
    return F.try_element_at(mapping, F.regexp_extract(path, r"(?:^|/)src/([^/]+)/", 1))


def category_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """Files per category; categories that found nothing are kept with zero."""
    spark = files.sparkSession
    names = spark.createDataFrame([(c,) for c in sorted(set(FOLDER_CATEGORIES.values()))], "category string")
    counts = files.groupBy(path_category(F.col(path)).alias("category")).agg(
        F.count(F.lit(1)).alias("n_files")
    )
    return names.join(counts, "category", "left").na.fill({"n_files": 0}).withColumn(
        "is_empty", F.col("n_files") == 0
    )


def read_class_facts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of class facts; attribute values keep their JSON type as variants."""
    return spark.read.schema(CLASS_FACTS_SCHEMA).json(path)


def read_examples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Examples numbered by file name and place in the file by `example_no`.

    A file is one JSON array, read by one task, or with `lines` one example per line, so that large
    files are split over tasks.
    """
    rows = spark.read.schema(EXAMPLES_SCHEMA).json(path, multiLine=not lines)
    # Rows of one block of a file are read in order by one task.
    placed = rows.withColumns(
        {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()}
    )
    return checked_position(placed, [], ["__file", "__block", "__at"], "example_no").drop("__file", "__block", "__at")


def write_examples(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Examples as JSON lines in the given order, over as many files as the rows need."""
    by = [F.col(c) for c in order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = [c for c in T.StructType.fromDDL(EXAMPLES_SCHEMA).names if c in df.columns]
    ranged.select(*kept).write.mode("overwrite").json(path)


def read_features(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Feature rows from CSV with a header, or from Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True, schema=FEATURES_SCHEMA, enforceSchema=False)
    kept = df.select(*columns) if columns else df
    floats = [c for c, t in kept.dtypes if t in ("double", "float")]
    # Other tools write missing numbers as NaN.
    return kept.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report is a few rows per feature: one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_scored(df: DataFrame, path: str, top_path: str | None = None, top: int = 30, score: str = "risk_score", ties: Sequence[str] = ()) -> None:
    """All scored rows as CSV, one file per partition; on request the `top` highest as one more file."""
    df.write.mode("overwrite").option("header", True).csv(path)
    if top_path:
        write_report(df.orderBy(F.col(score).desc(), *ties).limit(top), top_path)


def missing_columns(df: DataFrame, needed: Iterable[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in needed if c not in present]

"""Reading and writing tables: CSV, folders of CSV datasets, JSON documents, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.schema import categorical_columns, nan_to_null, numeric_columns
from sondage.operators.profile import absent, column_aggregates

CORRUPT = "_corrupt"


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, header: bool = True,
    keep_corrupt: bool = False, sampling: float = 1.0,
) -> DataFrame:
    """Read CSV.  With a schema nothing is inferred and, if asked, malformed lines are kept in ``_corrupt``.

    Without one the types are inferred in a first pass over the files, which a
    schema avoids; a ``sampling`` below 1 shortens it but may miss rare values.
    """
    reader = spark.read.option("header", header)
    if schema is None:
        return nan_to_null(reader.option("inferSchema", True).option("samplingRatio", sampling).csv(path))
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return nan_to_null(reader.schema(schema).csv(path))


def scan_datasets(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All CSV datasets below ``folder`` in one read; ``dataset_id`` is the file or folder name."""
    rows = (
        spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        .schema(schema).csv(folder)
    )
    below = F.substring_index(F.col("_metadata.file_path"), f"{folder.rstrip('/').split('/')[-1]}/", -1)
    name = F.split_part(below, F.lit("/"), F.lit(1))
    return nan_to_null(rows.withColumn("dataset_id", F.regexp_replace(name, r"\.csv$", "")))


def dataset_summaries(rows: DataFrame, dataset: str, target: str) -> DataFrame:
    """One row per dataset: rows, features, missing cells, classes.  One grouped pass."""
    data = [c for c in rows.columns if c != dataset]
    gaps = absent(rows)
    missing = sum([gaps[c].cast("long") for c in data], F.lit(0).cast("long"))
    return rows.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(missing).alias("missing_total"), F.count_distinct(target).alias("n_classes")
    ).withColumn("n_features", F.lit(len(data) - 1))


def preview_schema(df: DataFrame) -> DataFrame:
    """(column, dtype, role, missing, n_rows) for every column, from one aggregate per chunk of columns."""
    numeric, categorical = set(numeric_columns(df)), set(categorical_columns(df))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    gaps = absent(df)

    def stats(c):
        role = "numeric" if c in numeric else "categorical" if c in categorical else "other"
        return {"dtype": F.lit(types[c]), "role": F.lit(role), "missing": F.count_if(gaps[c]),
                "n_rows": F.count(F.lit(1))}

    return column_aggregates(df, df.columns, stats).withColumnRenamed("feature", "column")


def preview_rows(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(key).limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def sample_rows(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The downloadable sample: the first rows by key."""
    return df.orderBy(key).limit(n)


def as_document(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)

"""Readers for nested playlist files, reader and writer for the five flat tables."""

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from encore import schemas
from encore.operators.field_report import field_report

SLICE_PATTERN = "*.slice.*.json"
CORRUPT = "_corrupt_record"


def _read_nested(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    readable = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(readable).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def read_slices(spark: SparkSession, folder: str, pattern: str = SLICE_PATTERN) -> DataFrame:
    """Slice files of a folder. The pattern keeps a challenge file in the same folder out of training."""
    return _read_nested(spark, f"{folder.rstrip('/')}/{pattern}", schemas.SLICE)


def read_challenge(spark: SparkSession, path: str) -> DataFrame:
    return _read_nested(spark, path, schemas.CHALLENGE)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): each file that parses as one VARIANT, with all its fields."""
    return (spark.read.option("multiLine", True).option("singleVariantColumn", "record").json(path)
            .select(F.col("_metadata.file_name").alias("file"), "record"))


def slice_fields(spark: SparkSession, folder: str, pattern: str = SLICE_PATTERN) -> DataFrame:
    """What the slice files of a folder hold beside what their schema names."""
    return field_report(read_variants(spark, f"{folder.rstrip('/')}/{pattern}"), schemas.SLICE)


def unreadable_files(raw: DataFrame) -> DataFrame:
    """Files that did not parse, with what was found in them."""
    return raw.filter(F.col(CORRUPT).isNotNull()).select(F.input_file_name().alias("file"), CORRUPT)


@dataclass(frozen=True)
class Tables:
    """The five flat tables."""

    playlists_info: DataFrame
    tracks: DataFrame
    playlists_tracks: DataFrame
    playlists_test_info: DataFrame
    playlists_test: DataFrame


ORDER = {"tracks": ["track_uri"], "playlists_tracks": ["pid", "pos"], "playlists_test": ["pid", "pos"]}


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(**{f.name: read_table(spark, f.name, folder) for f in fields(Tables)})


def write_table(table: DataFrame, name: str, folder: str) -> None:
    """Overwrite one of the Parquet tables. Range order by id lets id filters skip files and row groups."""
    keys = ORDER.get(name, ["pid"])
    (table.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}"))


def write_bucketed(table: DataFrame, name: str, folder: str, buckets: int, database: str = "default") -> DataFrame:
    """Overwrite one of the tables that have a pid, as a catalog table of `buckets` files by pid, each sorted.

    Joins and aggregations by pid over such tables of one bucket count read the buckets as they lie, without a shuffle.
    """
    keys = ORDER.get(name, ["pid"])
    if keys[0] != "pid":
        raise ValueError(f"{name} is not kept by pid")
    (table.repartition(buckets, "pid").write.mode("overwrite").format("parquet").bucketBy(buckets, "pid").sortBy(*keys)
     .option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(f"{database}.{name}"))
    return table.sparkSession.table(f"{database}.{name}")


def open_bucketed(spark: SparkSession, name: str, folder: str, buckets: int, database: str = "default") -> DataFrame:
    """A table of `write_bucketed` in a session whose catalog does not know it yet."""
    path = f"{folder.rstrip('/')}/{name}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")  # of outside files, which stay
    spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet CLUSTERED BY (pid) "
              f"SORTED BY ({', '.join(ORDER.get(name, ['pid']))}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(f"{database}.{name}")


def write_tables(tables: Tables, folder: str) -> None:
    """Overwrite the five Parquet tables."""
    for f in fields(Tables):
        write_table(getattr(tables, f.name), f.name, folder)

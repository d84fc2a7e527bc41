"""Which fields nested files really hold: new, missing and retyped ones, found in every record of every file.

Files are read as VARIANT, so nothing the schemas do not name is lost on the way. Each level of the nesting (the file,
its playlists, their tracks) is taken apart once; counts combine before the shuffle, and the report has one row for
each field and type, however many records there are.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

KINDS = {T.LongType: "BIGINT", T.StringType: "STRING", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN",
         T.ArrayType: "ARRAY", T.StructType: "OBJECT"}
COLUMNS = ["level", "field", "expected", "found", "n_records", "n_files", "status"]


def _kind(kind: T.DataType) -> str:
    return KINDS.get(type(kind), "ANY")


def _exploded(records: DataFrame) -> DataFrame:
    """(file, record, key, value) of records (file, record) that are objects."""
    objects = records.filter(F.schema_of_variant("record").startswith("OBJECT"))
    return objects.lateralJoin(
        objects.sparkSession.tvf.variant_explode(F.col("record").outer()).select("key", "value"))


def _elements(records: DataFrame, field: str) -> DataFrame:
    """(file, record): the elements of an array field."""
    held = records.select("file", F.try_variant_get("record", f"$.{field}", "variant").alias("held"))
    arrays = held.filter(F.schema_of_variant("held").startswith("ARRAY"))
    return arrays.lateralJoin(arrays.sparkSession.tvf.variant_explode(F.col("held").outer()).select("value")).select(
        "file", F.col("value").alias("record"))


def _level(records: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    """The report of one level of the nesting."""
    spark = records.sparkSession
    found = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    fields = _exploded(records).select("file", F.col("key").alias("field"), found.alias("found"))
    counts = fields.groupBy("field", "found").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct("file").alias("n_files"))
    named = spark.createDataFrame([(f.name, _kind(f.dataType)) for f in schema.fields], "field string, expected string")
    number = F.col("found").isin("BIGINT", "DECIMAL", "DOUBLE") & (F.col("expected") == "DOUBLE")
    status = (
        F.when(F.col("expected").isNull(), "new")
        .when((F.col("found") == F.col("expected")) | (F.col("found") == "VOID") | (F.col("expected") == "ANY") | number, "known")
        .otherwise("retyped"))
    held = counts.join(F.broadcast(named), "field", "left").withColumn("status", status)

    # a named field that some records lack, and records that are no objects at all
    every = records.agg(F.count(F.lit(1)).alias("n"), F.count_if(
        ~F.schema_of_variant("record").startswith("OBJECT")).alias("others"), F.count_distinct("file").alias("files"))
    present = fields.groupBy("field").agg(F.count(F.lit(1)).alias("here"))
    absent = (
        named.join(present, "field", "left").withColumn("every", every.select(F.struct("*")).scalar())
        .withColumn("n_records", F.col("every.n") - F.col("every.others") - F.coalesce("here", F.lit(0).cast("bigint")))
        .filter("n_records > 0")
        .select("field", "expected", F.lit(None).cast("string").alias("found"), "n_records",
                F.lit(None).cast("bigint").alias("n_files"), F.lit("missing").alias("status")))
    broken = every.filter("others > 0").select(
        F.lit("").alias("field"), F.lit("OBJECT").alias("expected"), F.lit(None).cast("string").alias("found"),
        F.col("others").alias("n_records"), F.lit(None).cast("bigint").alias("n_files"), F.lit("retyped").alias("status"))
    columns = [c for c in COLUMNS if c != "level"]
    return held.select(columns).unionByName(absent.select(columns)).unionByName(broken.select(columns)).select(
        F.lit(name).alias("level"), *columns)


def field_report(files: DataFrame, schema: T.StructType) -> DataFrame:
    """(level, field, expected, found, n_records, n_files, status) of files (file, record), record being a VARIANT.

    status: known, new (a field the schema does not name), retyped (of another type than named) or missing (n_records lack
    it). A null is of every type. A level is a path such as `playlists[].tracks[]`; the file itself is `$`.
    """
    def walk(records, name, schema):
        report = _level(records, name, schema)
        for f in schema.fields:
            path = f.name if name == "$" else f"{name}.{f.name}"
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                report = report.unionByName(walk(_elements(records, f.name), f"{path}[]", f.dataType.elementType))
        return report

    return walk(files.select("file", "record"), "$", schema)

"""Track features as a fitted model: ranks and limits are learnt once, saved, and applied to any tracks later.

The model's ranks stay a table (field, value, index), as long as the names of the catalogue; only the limits of the four
numbers and the count of each field's names are single values. A saved model is a folder: Spark ML's metadata
beside the table. A name the model has not seen, or a missing one, takes the rank after all known names, and numbers outside
the limits count as the nearest limit, so every track gets a vector.
"""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, functions as F

from encore.functions.vectors import l2_normalised
from encore.operators.features import INDEXED, frequency_index, min_max
from encore.sources.stage import staged

PARTS = [*INDEXED.values(), "duration"]


class _Columns(Params):
    """Names of the two result columns."""

    scaledCol = Param(Params._dummy(), "scaledCol", "min-max scaled features", TypeConverters.toString)
    vectorCol = Param(Params._dummy(), "vectorCol", "features of unit length", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(scaledCol="scaled", vectorCol="vector")


def _duration(tracks: DataFrame):
    return F.coalesce(tracks["duration_ms"].cast("double"), F.lit(0.0))


class TrackFeatures(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns frequency ranks of album, artist and track names, and the limits of ranks and durations."""

    @keyword_only
    def __init__(self, *, scaledCol="scaled", vectorCol="vector"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, tracks: DataFrame) -> "TrackFeaturesModel":
        ranks = staged(frequency_index(tracks, list(INDEXED)), "ranks")
        counts = ranks.groupBy().agg(*[F.count_if(F.col("field") == f).alias(f) for f in INDEXED])
        missing = [F.max(F.col(f).isNull().cast("int")).alias(f) for f in INDEXED]
        seen = tracks.agg(F.count(F.lit(1)).alias("n"), F.min(_duration(tracks)).alias("lo"), F.max(_duration(tracks)).alias("hi"), *missing)
        known, facts = counts.first(), seen.first()
        if not facts["n"]:
            raise ValueError("there is no track to learn from")
        # ranks start at 0; where a name is missing, its rank is the highest
        highest = [float(known[f] - 1 + facts[f]) for f in INDEXED]
        lowest = [0.0 if known[f] else float(known[f]) for f in INDEXED]
        model = TrackFeaturesModel(
            ranks, [int(known[f]) for f in INDEXED], [*lowest, facts["lo"]], [*highest, facts["hi"]])
        return self._copyValues(model)


class TrackFeaturesModel(_Columns, Model, MLReadable, MLWritable):
    """ranks: the table; known: names per field; lowest and highest: the limits of the four features."""

    def __init__(self, ranks: DataFrame, known: list[int], lowest: list[float], highest: list[float]):
        super().__init__()
        self.ranks, self.known, self.lowest, self.highest = ranks, known, lowest, highest

    def _transform(self, tracks: DataFrame) -> DataFrame:
        columns, table = tracks.columns, tracks
        for (field, name), known in zip(INDEXED.items(), self.known):
            ranks = self.ranks.filter(F.col("field") == field).select(F.col("value").alias(field), F.col("index").alias(name))
            table = table.join(ranks, field, "left").withColumn(name, F.coalesce(F.col(name), F.lit(known)).cast("double"))
        table = table.withColumn("duration", _duration(table))
        scaled = F.array(*[
            min_max(F.least(F.greatest(F.col(p), F.lit(lo)), F.lit(hi)), F.lit(lo), F.lit(hi))
            for p, lo, hi in zip(PARTS, self.lowest, self.highest)])
        return table.withColumn(self.getOrDefault("scaledCol"), scaled).withColumn(
            self.getOrDefault("vectorCol"), l2_normalised(F.col(self.getOrDefault("scaledCol")))).select(
            *columns, *INDEXED.values(), self.getOrDefault("scaledCol"), self.getOrDefault("vectorCol"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: TrackFeaturesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, extraMetadata={
            "known": model.known, "lowest": model.lowest, "highest": model.highest})
        model.ranks.write.parquet(f"{path}/ranks")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TrackFeaturesModel:
        held = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        ranks = self.sparkSession.read.parquet(f"{path}/ranks")
        model = TrackFeaturesModel(ranks, held["known"], held["lowest"], held["highest"])
        model._resetUid(held["uid"])
        DefaultParamsReader.getAndSetParams(model, held)
        return model

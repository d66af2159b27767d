"""What becomes of items that a step can't do: one bad trace needn't end a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.session import scratch

SCHEMA = "step string, item string, problem string"


class ItemError(RuntimeError):
    """An item that couldn't be done, where the policy is to raise."""


class Quarantine:
    """The problems of a job's items by step. With ``on_error`` of ``continue`` an item with a
    problem has a row in :meth:`table` and no result; with ``raise`` the first one ends the job."""

    def __init__(self, spark: SparkSession, on_error: str = "continue"):
        if on_error not in ("continue", "raise"):
            raise ValueError(f"on_error {on_error}; known are continue, raise")
        self.spark, self.on_error = spark, on_error
        self.frames: list[DataFrame] = []

    def split(self, step: str, key: list[str], found: DataFrame) -> DataFrame:
        """The rows of ``found`` without a ``problem``; the others are kept by their key. ``found`` is
        written once, so that its work isn't repeated for both."""
        path = scratch(self.spark, f"items-{step}")
        found.write.parquet(path)
        found = self.spark.read.schema(found.schema).parquet(path)
        bad = found.filter("problem IS NOT NULL").select(F.lit(step).alias("step"), F.to_json(F.struct(*key)).alias("item"), "problem")
        if self.on_error == "raise" and (first := bad.first()):
            raise ItemError(f"{first.step}: {first.item}: {first.problem}")
        self.frames.append(bad)
        return found.filter("problem IS NULL").drop("problem")

    def sound(self, step: str, key: list[str], work: DataFrame, array: str) -> DataFrame:
        """The rows of ``work`` whose ``array`` isn't null and has only finite elements; of the others
        the keys are kept. Both are one scan of ``work`` each, and nothing is shuffled."""
        odd = F.exists(array, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
        problem = F.when(F.col(array).isNull(), "no samples").when(odd, "samples that aren't finite")
        bad = work.select(*key, problem.alias("problem")).filter("problem IS NOT NULL")
        self.frames.append(bad.select(F.lit(step).alias("step"), F.to_json(F.struct(*key)).alias("item"), "problem"))
        if self.on_error == "raise" and (first := self.frames[-1].first()):
            raise ItemError(f"{first.step}: {first.item}: {first.problem}")
        return work.filter(problem.isNull())

    def table(self) -> DataFrame:
        """(``step``, ``item``, ``problem``): one row for each item of a step; ``item`` is its key as
        JSON. Made to be upserted into a table of snapshots by step and item."""
        if not self.frames:
            return self.spark.createDataFrame([], SCHEMA)
        return reduce(DataFrame.unionByName, self.frames).groupBy("step", "item").agg(F.min("problem").alias("problem"))

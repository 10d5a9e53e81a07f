"""Table functions for SQL: ``SELECT * FROM steady_sections(TABLE(steps), 8.0)`` after ``register(spark)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class SteadySections:
    """Sections of rows whose step accelerations differ by at most ``spread``, of a table with run_id, seg, accel.

    The table is partitioned by run and ordered by row by the function itself; run ids are of any type.
    A null acceleration ends a section. The same sections as ``operators.sections.sections``.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, spread: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"run_id", "seg", "accel"} <= {f.name for f in rows.dataType.fields}:
            raise ValueError("steady_sections takes a table with the columns run_id, seg and accel")
        schema = StructType([rows.dataType["run_id"], StructField("l", IntegerType()), StructField("r", IntegerType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("run_id")], orderBy=[OrderingColumn("seg")])

    def __init__(self):
        self.run = self.start = self.last = None
        self.low = self.high = 0.0

    def eval(self, rows, spread):
        accel, seg = rows["accel"], rows["seg"]
        self.run = rows["run_id"]
        if accel is None:
            if self.start is not None:
                yield self.run, self.start, self.last
            self.start = None
        elif self.start is None:
            self.start, self.low, self.high = self.last, accel, accel
        elif max(self.high, accel) - min(self.low, accel) > spread:
            yield self.run, self.start, self.last
            self.start, self.low, self.high = self.last, accel, accel
        else:
            self.low, self.high = min(self.low, accel), max(self.high, accel)
        self.last = seg

    def terminate(self):
        if self.start is not None:
            yield self.run, self.start, self.last


def register(spark: SparkSession) -> None:
    spark.udtf.register("steady_sections", udtf(SteadySections))

"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_stage, write_stage
from .chunks import end_task

#: The white space that text equality and shingling treat alike, as a Java and DuckDB pattern.
WHITE = r"[\x20\x09-\x0D]+"
#: Parts into which the rows of one key are dealt where a key may hold a large share of all rows.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def salt(column: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as no column of ``df`` has it (Spark tells no letter case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers (once)."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(path))  # the driver serves it to the executors
        _SHIPPED.add(context.applicationId)


def map_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow``, with this package given to the workers, which give their memory back when a task ends."""
    ship_package(rows.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        end_task()

    return rows.mapInArrow(whole, schema)


class Scratch:
    """Tables in the shared folder that one operator writes and deletes when it is done with them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: a lost executor then costs a re-read."""
        out, self.paths[name] = write_stage(df, name)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            drop_stage(self.spark, self.paths.pop(name))

"""What the operators share: tables written to the shared folder, and text columns that are never null."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources import shared_path, table

__all__ = ["fresh", "place", "remove", "scratch", "shared_path", "ship_package", "table", "text_of", "written"]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that they need not have it installed."""
    package, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _shipped or not package.is_dir():
        return
    packed = Path(tempfile.mkdtemp(prefix="sievework-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(app)


#: The folder that written() fills at present, if not the shared one itself.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of the shared folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What written() writes inside is deleted at the end, so results must have been written elsewhere by then."""
    folder = shared_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def place(spark: SparkSession, label: str) -> str:
    """Where written() puts a table with this label: in the folder that is filled at present, or the shared one."""
    path = shared_path(spark, label)
    return f"{folder}/{path.rpartition('/')[2]}" if (folder := _scratch.get()) else path


#: Spark's setting by which a query's shuffle files are deleted when it ends, not when the driver next collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, a lost executor costs nothing, and nothing else of it is left on disk."""
    spark, path = df.sparkSession, path or place(df.sparkSession, label)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that no column of ``df`` has; Spark tells no cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))

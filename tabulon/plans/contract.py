"""What the driver calls: every registered query with its SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each context, so that their functions import it."""
    context = spark.sparkContext
    if getattr(context, "_tabulon_shipped", False):
        return
    made, path = tempfile.mkstemp(prefix="tabulon-", suffix=".zip")
    os.close(made)
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    context._tabulon_shipped = True


def shipped(query: Query) -> Query:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    call.__name__, call.__doc__ = query.__name__, query.__doc__
    return call

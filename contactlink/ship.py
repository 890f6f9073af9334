"""Sending the package to the workers of a cluster it is not installed on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, for a driver that runs from a checkout.

    The same as giving a zip of the package to ``--py-files``. Not needed where the workers can import it.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        source = os.path.join(folder, "source")
        shutil.copytree(package, os.path.join(source, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "contactlink"), "zip", source))

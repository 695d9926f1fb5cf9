"""What a session needs besides plans: the package on its workers, and tables between steps in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers through Spark's own file server, once for each application.

    Nothing is sent when PYTHONPATH already names the folder that holds the package.
    """
    app = spark.sparkContext.applicationId
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _SHIPPED or str(_ROOT.parent) in known:
        return
    folder = tempfile.mkdtemp(prefix="corvane-code-")  # on the driver only: its file server hands it out until the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{_ROOT.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, f"{_ROOT.name}/{p.relative_to(_ROOT)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without that setting gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table of the shared folder: plans that read it start there, and a lost executor loses nothing of it.

    by: a column of few values; each gets a folder of its own, so that a plan that asks for one reads no other.
    """
    path = f"{shared_folder(df.sparkSession)}/corvane/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

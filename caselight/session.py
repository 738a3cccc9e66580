"""What every job needs of its session: the package on the executors, and cuts of lineage in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that they can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        folder = tempfile.mkdtemp(prefix="caselight-")
        atexit.register(shutil.rmtree, folder, True)
        package = Path(__file__).resolve().parent
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/caselight-package", "zip", package.parent, package.name))
        _shipped.add(app)
    return spark


def apart(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the settings of this one and some of its own, which hold there alone."""
    own = spark.newSession()
    for name, value in (spark.conf.getAll | settings).items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; without one, in local mode, a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="caselight-checkpoints-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession, name: str) -> str:
    """A new place for a job's own tables in the shared folder."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the folder in spark.checkpoint.dir and read from there, so that an executor's loss costs nothing before."""
    _shared(df.sparkSession)
    return df.checkpoint()

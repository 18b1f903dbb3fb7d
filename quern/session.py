"""Session construction and the settings every plan in the library relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: UTC keeps batch results comparable with other engines; AQE re-plans joins and splits skewed partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "quern", cores: int | None = None, **settings: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the submitter owns the session."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    conf = DEFAULTS | {
        "spark.master": f"local[{cores}]",
        "spark.app.name": name,
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(cores),
    }
    spark = SparkSession.builder.config(map=conf | settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of one Arrow batch, unless the session or its submitter set another number: texts are long, and several batches are
#: in flight between an executor and its Python workers.
ARROW_ROWS = 1_000
ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

_SHIPPED: set[str] = set()


def prepared(spark: SparkSession) -> None:
    """Let Python workers import this library, and give Arrow batches their size where nobody has chosen one.

    Every function that makes a Python stage calls this before it does, so operators work on any DataFrame. Workers of one
    machine find the library where the driver has it; executors of a cluster get an archive of it.
    """
    if not spark._jsparkSession.sessionState().conf().contains(ARROW_KEY):
        spark.conf.set(ARROW_KEY, str(ARROW_ROWS))
    home, context = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([home, *paths])
    if not context.master.startswith("local") and context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        context.addPyFile(_archive(home))


def _archive(home: str) -> str:
    """A ZIP file of the package's sources, in the driver's temporary folder; Spark serves it to executors."""
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="quern-"), f"{package}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(home, package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, home))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by whatever file system the path names."""
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

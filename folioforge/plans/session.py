"""Session set-up, table loading and lineage cuts.

Nothing here is specific to one operator.  ``cut`` is the only way iterative
operators of this package materialise intermediate results: a Parquet table in
the folder that ``spark.checkpoint.dir`` names.  That folder is shared by all
executors, so a lost executor costs a re-read, never a lost result.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "folioforge") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns and filters are pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster's own setting wins.  Only a local session without one gets a
    temporary folder, which is then recorded in the session; elsewhere a folder of
    one machine would lose what other machines wrote, so that is an error.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set(CHECKPOINT_CONF, found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "step", measure: dict[str, Column] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so its lineage ends here.

    ``measure`` names aggregates that are taken while it's written; they are in
    ``_folio_measures`` of the result and cost no further job.
    """
    path = f"{shared_dir(df.sparkSession)}/folioforge-{label}-{uuid.uuid4().hex}"
    seen = Observation() if measure else None
    out = df.observe(seen, *[c.alias(k) for k, c in measure.items()]) if measure else df
    out.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._folio_path = path
    back._folio_measures = seen.get if seen else {}
    _written.append(path)
    return back


_written: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` wrote in this process, once no result that reads them is needed; how many there were."""
    paths, _written[:] = list(_written), []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``cut`` that no later plan reads."""
    path = getattr(df, "_folio_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_folio_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    # served by the driver; executors fetch it from there
    archive = shutil.make_archive(tempfile.mkdtemp(prefix="folioforge-code-") + "/folioforge", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._folio_shipped = True

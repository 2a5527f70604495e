"""Session defaults. A cluster's own settings win: only unset values are filled in."""

import io
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def package() -> bytes:
    """This package as a zip archive that Python can import from."""
    root, out = pathlib.Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors, which need it for the Python steps.

    Spark copies the archive to every executor; the file on the driver is only its source.
    """
    archive = pathlib.Path(tempfile.mkdtemp()) / "arrears.zip"
    archive.write_bytes(package())
    spark.sparkContext.addPyFile(str(archive))


def session(master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName("arrears")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Call-site capture costs several JVM round trips per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in defaults.items():
        builder = builder.config(key, value)
    built = builder.getOrCreate()
    if not built.sparkContext.master.startswith("local"):
        ship(built)
    return built

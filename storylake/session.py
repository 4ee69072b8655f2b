"""One place for the session settings that the library relies on."""

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "storylake") -> SparkSession:
    """A local session for tests and benchmarks, whose shared folder goes when Python ends; on a cluster the caller brings its own."""
    folder = tempfile.mkdtemp(prefix="storylake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", folder)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

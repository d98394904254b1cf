"""Prime-set analytics on Spark."""

import os
import tempfile

_OWN: dict[str, str] = {}


def shared_folder(spark) -> str:
    """The folder that all tasks share: spark.checkpoint.dir; where that is unset, one in the warehouse on a cluster, and a
    temporary one in local mode (tests). It is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        folder = _OWN.setdefault("folder", tempfile.mkdtemp(prefix="stages-")) if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def importable(spark) -> None:
    """Lets Python workers on this machine import the package from where the driver did; clusters get it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))

"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job assumes: UTC clock (the driver tables are TIMESTAMP_NTZ and are
# compared against DuckDB, which is zone-less), AQE on for runtime coalescing and
# skew-join splitting, and no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The connector (A8) applies filters itself.
    "spark.sql.python.filterPushdown.enabled": "true",
    # Broadcast only below a fixed, known bound; everything above is a shuffle join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above; local mode only for tests."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:  # tests and the bench; a cluster sets its own
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:
        pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the Python workers (UDFs, mapInPandas, the data source).

    The package sources are zipped once per content version and added with
    ``addPyFile`` — the same thing ``--py-files`` does at submit time — so executors never
    depend on the driver's working directory.
    """
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # no SparkContext handle (e.g. Spark Connect): ship with --py-files instead
        return
    if app in _SHIPPED:
        return
    import hashlib
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    files = []
    for d, _, names in os.walk(pkg):
        for n in sorted(names):
            if n.endswith(".py"):
                files.append(os.path.join(d, n))
    digest = hashlib.sha1()
    for f in sorted(files):
        digest.update(os.path.relpath(f, root).encode())
        with open(f, "rb") as fh:
            digest.update(fh.read())
    base = ensure_checkpoint_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else base
    folder = local if "://" not in local else tempfile.gettempdir()
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"quarry-{digest.hexdigest()[:12]}.zip")
    if not os.path.exists(target):
        tmp = target + f".{uuid.uuid4().hex[:8]}.part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(files):
                z.write(f, os.path.relpath(f, root))
        os.replace(tmp, target)
    sc.addPyFile(target)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is. Only when it
    is unset (local tests) do we pick a fresh scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="quarry-ckpt-", dir=os.environ.get("QUARRY_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # sessions without a SparkContext handle
        pass
    return current


def checkpoint_path(spark: SparkSession, name: str, unique: bool = False) -> str:
    """A sub-folder of the shared checkpoint location (streaming checkpoints, state tables).

    ``unique=True`` appends a fresh suffix: a new run never resumes (or overwrites) an
    older run's checkpoint.
    """
    base = ensure_checkpoint_dir(spark)
    if unique:
        name = f"{name}-{uuid.uuid4().hex[:12]}"
    return base.rstrip("/") + "/" + name

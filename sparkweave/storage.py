"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}
#: By a frame's id: the frame (so that the id stays its own), its folder, and its table's name if it is one.
_STORED: dict[int, tuple[DataFrame, str, str | None]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary one, if driver and executors are one process; else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sparkweave-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _observed(seen: Observation, stored: DataFrame, metrics: dict[str, Column]) -> dict:
    """What ``seen`` saw. Spark takes an observation out of a plan that turns out to have no rows; then the metrics are those of what is ``stored``."""
    if seen._jo.getRow().length():
        return seen.get
    return stored.agg(*(c.alias(k) for k, c in metrics.items())).first().asDict()


def materialize(df: DataFrame, label: str, metrics: dict[str, Column] | None = None, seen: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage, so nothing above it is computed twice, and an executor
    that is lost later takes nothing with it. Values of ``metrics``, taken while it
    is written, go to ``seen``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    values = Observation()
    if metrics:
        df = df.observe(values, *(c.alias(k) for k, c in metrics.items()))
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED[id(stored)] = (stored, path, None)
    if metrics:
        seen.update(_observed(values, stored, metrics))
    return stored


def checkpointed(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``df`` as a reliable checkpoint in the shared folder, and the values of ``metrics``: cheaper than a table for rows that are few and read once or twice."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(spark))
    seen = Observation()
    stored = df.observe(seen, *(c.alias(k) for k, c in metrics.items())).checkpoint()
    path = stored._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    _STORED[id(stored)] = (stored, path, None)
    return stored, _observed(seen, stored, metrics)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, key: str, label: str, metrics: dict[str, Column] | None = None, placed: bool = False) -> tuple[DataFrame, dict]:
    """``df`` as a table bucketed by ``key``, and the values of ``metrics``, taken while it is written.

    Joins and aggregates on the key read it without a shuffle. The number of
    buckets is that of shuffle partitions, so whatever is joined lines up. A
    frame that a join with such a table has ``placed`` by the key already isn't
    shuffled again: each of its tasks holds whole buckets.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    seen = Observation()
    if metrics:
        df = df.observe(seen, *(c.alias(k) for k, c in metrics.items()))
    path = new_path(spark, label)
    dealt = df if placed else df.repartition(n, key)
    dealt.write.bucketBy(n, key).option("path", path).saveAsTable(name)
    stored = spark.table(name)
    _STORED[id(stored)] = (stored, path, name)
    return stored, _observed(seen, stored, metrics) if metrics else {}


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` or ``bucketed`` wrote for ``df``, once nothing reads it any more."""
    _, path, name = _STORED.pop(id(df))
    if name:
        df.sparkSession.sql(f"DROP TABLE {name}")
    delete_path(df.sparkSession, path)


def release() -> None:
    """Delete all that is stored and not discarded yet, once no result that reads it is wanted any more."""
    for df, _, _ in list(_STORED.values()):
        discard(df)

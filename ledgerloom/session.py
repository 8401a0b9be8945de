"""Session set-up, table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast; both are measured before each broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def build_session(master: str = "local[*]", app: str = "ledgerloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for; keyword names use ``__`` for dots."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files go when the frames that read them are gone
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary one on a single machine and an error on a cluster,
    whose executors could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and return it without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Rough size of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = lambda x: _bytes(x, kind.elementType).cast("long")
        return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + each(x)), F.lit(16))
    if isinstance(kind, T.StructType):
        return sum((_bytes(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return F.lit(8)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and their rough size in memory."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32)).cast("long")
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first())


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else without (a shuffled join).

    ``df`` is run once: it is written to the shared folder and measured there.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRDD":
        df = cut(df)
    n, total = measured(df)
    return F.broadcast(df) if n <= rows and total <= size else df


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, which is evaluated once per row however often later expressions use it.

    The optimizer writes a projected expression into each of its uses; it does not look
    through a generator, here one of a single element.
    """
    return df.select(*[f"`{c}`" for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores over all cores; any larger scan is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

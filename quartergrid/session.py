"""Session set-up, UTC pinning and durable lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from typing import TypeVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

Result = TypeVar("Result")


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Build the session used by the tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quartergrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """Pin the session clock; date and timestamp casts below assume UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is used only on a local master, where driver and tasks share
    the disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def durable(frame: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor costs only a re-read."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage and return freed memory to the system.

    A long job else grows the driver's heap step by step, and Spark drops the shuffles,
    broadcasts and checkpoints of finished steps only when the driver collects.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with suppress(Py4JError):  # not every JVM can trim what its compiler threads freed
        call = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        call[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call[1] = "systemTrimNativeHeap"
        # By the interface's method; the server's own class is not open to callers.
        methods = jvm.Class.forName("javax.management.MBeanServer").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)


def together(spark: SparkSession, calls: Iterable[Callable[[], Result]], at_once: int = 4) -> list[Result]:
    """Results of independent calls that submit their Spark jobs side by side, in order."""
    shared_folder(spark)
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda call: call()), list(calls)))

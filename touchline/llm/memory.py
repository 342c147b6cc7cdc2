"""Python workers outlive their tasks and keep what they have freed; beside the JVM's heap that is memory an executor lacks later. So does the driver."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives freed memory of Arrow's pool and of the C library back to the system. Without glibc only the pool's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def relieve(spark: SparkSession) -> str:
    """Collects the driver's garbage and gives its freed memory back: the JVM's heap and native memory, and Python's. The JVM's own words on the latter, empty if it has no such command.

    The heap grows with the garbage of plans, and each planning or broadcasting thread leaves an arena of the C library behind.
    """
    release()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.java.lang.System.gc()
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    # By reflection on the public interface, as the bean server's own class is closed to callers.
    signature, values = new(jvm.java.lang.Class, len(kinds)), new(jvm.java.lang.Object, len(kinds))
    try:
        for i, kind in enumerate(kinds):
            signature[i] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", signature)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return ""


def released(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow() that releases when its partition is done."""

    def run(batches: Batches) -> Batches:
        yield from function(batches)
        release()

    return run

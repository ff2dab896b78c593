"""Small files and shared folders on whatever file system Spark is set up for."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only where Spark runs on one machine, a temporary one stands in."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="halyard-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fs(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, f = fs(spark, path)
    return f.exists(p)


def read(spark: SparkSession, path: str) -> bytes | None:
    """What a file holds, None where there is none; OSError where it can't be read."""
    p, f = fs(spark, path)
    if not f.exists(p):
        return None
    stream = f.open(p)
    try:
        return bytes(stream.readAllBytes())
    except Py4JJavaError as e:
        raise OSError(f"{path} can't be read") from e
    finally:
        stream.close()


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Write `data` beside `path`, force it to disk, and rename it into place, over what is there."""
    jvm = spark._jvm
    new, f = fs(spark, f"{path}.{time.time_ns()}")
    stream = f.create(new, True)
    stream.write(bytearray(data))
    stream.hsync()
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(f.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(path), options)


def create(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write `data` to a new file, whole or not at all; False if there is one already, whoever else tries at once.

    A file's name is given to its finished content by a hard link on a local disk, elsewhere by a rename that doesn't overwrite.
    """
    jvm, (target, f) = spark._jvm, fs(spark, path)
    f.mkdirs(target.getParent())
    folder = f.resolvePath(target.getParent())
    f = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    target, new = (jvm.org.apache.hadoop.fs.Path(folder, x) for x in (target.getName(), f".{target.getName()}.{uuid.uuid4().hex}"))
    stream = f.create(new, False)
    stream.write(bytearray(data))
    stream.hsync()
    stream.close()
    try:
        if f.getUri().getScheme() == "file":
            at = [jvm.java.nio.file.Paths.get(x.toUri()) for x in (target, new)]
            jvm.java.nio.file.Files.createLink(*at)
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(f.getUri(), spark._jsc.hadoopConfiguration()).rename(new, target, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        f.delete(new, False)
    return True


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was changed."""
    p, f = fs(spark, path)
    return time.time() - f.getFileStatus(p).getModificationTime() / 1000


def delete(spark: SparkSession, path: str) -> None:
    p, f = fs(spark, path)
    f.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it isn't there."""
    p, f = fs(spark, path)
    return [x.getPath().getName() for x in f.listStatus(p)] if f.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below `path`."""
    p, f = fs(spark, path)
    return f.getContentSummary(p).getLength()

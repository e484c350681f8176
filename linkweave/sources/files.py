"""Small files on the shared file system: written once, under a name that is never replaced."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the ``<number>.json`` files in a folder, ascending; none if it is missing."""
    fs, place = file_system(spark, folder)
    if not fs.exists(place):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside ``path``, then rename it into place; ``FileExistsError`` if the file is there already."""
    jvm = spark._jvm
    fs, beside = file_system(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside)
    stream.write(bytearray(text.encode()))
    stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(beside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), no_options)
    except Py4JJavaError as error:
        fs.delete(beside, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise FileExistsError(path) from error
        raise

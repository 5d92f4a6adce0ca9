"""Files in the cluster's shared folder, for tasks that write or map whole files themselves.

Paths are URIs. A ``file:`` URI is a mounted folder; others go through ``pyarrow.fs``, which knows
hdfs, s3, gs and abfs.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from thicket.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder for one run."""
    root = shared_folder(spark).rstrip("/")
    return f"{root}/thicket-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write(uri: str, data: bytes | pa.Buffer) -> None:
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def mapped(uri: str) -> pa.NativeFile:
    """A file mapped into memory where the folder is mounted, else read as a whole."""
    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(path)
    with system.open_input_file(path) as source:
        return pa.BufferReader(source.read_buffer())

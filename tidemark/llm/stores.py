"""Files that tasks write to and read from the shared folder, by the folder's own file system."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from tidemark.llm.frames import shared_folder


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """The URI of a new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` and plain paths are local."""
    if re.match(r"file:/|/", uri):
        return fs.LocalFileSystem(), "/" + re.sub(r"^(file:)?/+", "", uri)
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, number: int) -> str:
    """A file name no other attempt of any task uses, so a lost task's files never mix with its successor's."""
    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}"


def written(folder: str, name: str, data: bytes) -> str:
    """Write a file under a temporary name, then move it into place."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/.{name}", compression=None) as out:
        out.write(data)
    system.move(f"{path}/.{name}", f"{path}/{name}")
    return f"{folder}/{name}"

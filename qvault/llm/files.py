"""Files in the shared folder from tasks and back, by way of pyarrow's file systems (local, object stores, HDFS)."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it; ``file:/x`` and plain paths are local."""
    local = re.sub(r"^file:/+", "/", uri)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = resolve(uri)
    system.create_dir(path, recursive=True)


def unique_name(task: int, suffix: str) -> str:
    """A name that no other attempt of the task uses: what a lost attempt leaves is never read."""
    return f"part-{task:06d}-{uuid.uuid4().hex}{suffix}"

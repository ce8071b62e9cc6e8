"""Files that tasks write below the shared folder, through the public file system API of Arrow."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def publish(uri: str, write) -> None:
    """Create ``uri`` with what ``write(stream)`` puts into it.

    The bytes go to a name of this attempt first and are moved when complete, so that a task that
    runs again after a lost executor, or runs twice, never leaves a half-written file.
    """
    store, path = _resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as stream:
        write(stream)
    store.move(part, path)


def open_seekable(uri: str) -> BinaryIO:
    """A random-access reader."""
    store, path = _resolve(uri)
    return store.open_input_file(path)


def local_path(uri: str) -> str | None:
    """The path to map, when the folder is mounted on this machine; None for a remote store."""
    store, path = _resolve(uri)
    return path if isinstance(store, fs.LocalFileSystem) else None

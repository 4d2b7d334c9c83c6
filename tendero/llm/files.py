"""Files that tasks write and read themselves, at any address pyarrow can open."""

from __future__ import annotations

import re
from typing import Any

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``file:``, ``hdfs:``, ``s3:`` or ``gs:`` addresses and of plain paths."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def create(uri: str) -> Any:
    """A new file to write to, with the folders above it."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def reader(uri: str) -> Any:
    """A file to read ranges of with ``read_at(length, offset)``."""
    system, path = opened(uri)
    return system.open_input_file(path)

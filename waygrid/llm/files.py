"""Plain files in the shared folder, from any task: whatever file system the folder's URI names."""

from __future__ import annotations

import re

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if m := re.match(r"file:/+(.*)", uri):
        uri = f"/{m[1]}"
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream; folders above are made."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = open_fs(uri)
    return system.open_input_file(path)

"""Files that tasks write and read themselves, in the shared folder of the job."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder named by URI or by local path."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), os.path.abspath(uri)


def write_whole(folder: str, name: str, parts: list) -> int:
    """Write a file under another name, then rename it: readers see it whole or not at all."""
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with system.open_output_stream(draft) as out:
        for part in parts:
            size += len(part)
            out.write(part)
    system.move(draft, f"{base}/{name}")
    return size


def read_whole(folder: str, name: str) -> bytes:
    system, base = open_folder(folder)
    with system.open_input_stream(f"{base}/{name}") as file:
        return file.read()

"""Files of our own formats in the shared folder, by any URI that pyarrow's file systems know. A file appears whole or not at all."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, name: str, parts: list[bytes]) -> str:
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    held = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(held, compression=None) as out:
        for part in parts:
            out.write(part)
    system.move(held, f"{path}/{name}")  # a retried task replaces the same name with the same bytes
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()

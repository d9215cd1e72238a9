"""Files of Python workers in the shared folder, whatever store it is on."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np


def _split(uri: str):
    from pyarrow import fs

    if uri.startswith("/") or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_atomic(uri: str, *chunks: bytes) -> None:
    """Write under a name of this attempt, then rename: a repeated or lost task leaves no half file."""
    where, path = _split(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as f:
        for c in chunks:
            f.write(c)
    where.move(part, path)


def mapped(uri: str):
    """A buffer of the file: a memory map on a mounted store, else its bytes."""
    from pyarrow import fs

    where, path = _split(uri)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else b""
    with where.open_input_file(path) as f:
        return f.read()

"""Files in the shared folder, written and read inside tasks by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(folder: str, name: str, data: bytes) -> str:
    """Writes a file under a name that no other attempt of the task uses, and returns its URI."""
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    name = f"{uuid.uuid4().hex[:12]}-{name}"
    with store.open_output_stream(f"{at}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder.rstrip('/')}/{name}"


def get(uri: str) -> bytes:
    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_file(at) as src:
        return src.read()

"""Whole files in any store that tasks write and read themselves."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit


def local_path(uri: str) -> str | None:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme == "file" else uri if not parts.scheme else None


def write_file(uri: str, data: bytes) -> None:
    """Appears whole or not at all under a local or mounted path; other stores are left to Arrow's file systems."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(at) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


@contextlib.contextmanager
def opened(uri: str) -> Iterator[tuple[Callable[[int, int], bytes], int]]:
    """read(offset, length), and the size, of a file."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        file = store.open_input_file(at)
        size = file.size()
    else:
        file = open(path, "rb")  # noqa: SIM115
        size = os.path.getsize(path)
    with file:

        def read(offset: int, length: int) -> bytes:
            file.seek(offset)
            data = file.read(length)
            if len(data) != length:
                raise ValueError(f"{uri} ends before byte {offset + length}")
            return data

        yield read, size

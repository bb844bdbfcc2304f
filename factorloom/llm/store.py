"""Binary files in the folder that the driver and all executors share."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI that pyarrow knows (file, hdfs, s3, gs, ...); a plain path is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def new_file(uri: str) -> Iterator:
    """A stream to a new file, which gets its name only once it is complete."""
    system, path = opened(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(f"{path}.part") as out:
        yield out
    system.move(f"{path}.part", path)


def read_range(uri: str, offset: int, size: int) -> bytes:
    """Bytes of a file from `offset`, as many as `size` or up to its end."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, offset)


def pieces(uri: str, size: int) -> Iterator[bytes]:
    """The bytes of a file from its beginning to its end, `size` at a time."""
    system, path = opened(uri)
    with system.open_input_stream(path, compression=None) as f:  # not by the name of the file
        while piece := f.read(size):
            yield piece

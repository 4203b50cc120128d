"""Binary files on the shared storage, written and read by tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def storage(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; an address without scheme is a path."""
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def whole_file(uri: str) -> Iterator[object]:
    """A file that appears under its name once it is complete.

    Two attempts at the same task write the same bytes under the same name.
    """
    system, path = storage(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        yield out
    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)  # a rename replaces a file on local storage alone
    system.move(draft, path)


def size_of(uri: str) -> int:
    system, path = storage(uri)
    return system.get_file_info(path).size


@contextmanager
def opened(uri: str) -> Iterator[object]:
    """A file to read at any place."""
    system, path = storage(uri)
    with system.open_input_file(path) as source:
        yield source


def listed(uri: str, ending: str) -> list[tuple[str, int]]:
    """Names and sizes of a folder's files with an ending, sorted by name."""
    system, path = storage(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.base_name.endswith(ending))

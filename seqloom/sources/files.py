"""Files of any file system that pyarrow opens."""

from __future__ import annotations

import gzip
import io
import os


def local_path(path: str) -> str:
    """Of a path or a file URI, with one slash or three."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def file_system(path: str):
    """(pyarrow file system, path within it)."""
    from pyarrow import fs

    if not is_local(path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(local_path(path))


def open_raw(path: str) -> io.BufferedIOBase:
    """The file's bytes as they are."""
    if is_local(path):
        return open(local_path(path), "rb")
    system, inner = file_system(path)
    return system.open_input_file(inner)


def open_file(path: str) -> io.BufferedIOBase:
    """A local path, or any URI that a pyarrow file system reads; ``.gz`` is unpacked."""
    raw = open_raw(path)
    return gzip.open(raw) if path.endswith(".gz") else raw


def file_size(path: str) -> int:
    system, inner = file_system(path)
    return system.get_file_info(inner).size or 0


def exists(path: str) -> bool:
    from pyarrow import fs

    system, inner = file_system(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def delete_folder(path: str) -> None:
    if exists(path):
        system, inner = file_system(path)
        system.delete_dir(inner)


def list_files(folder: str) -> list[str]:
    """The data files of a folder, by name: what ``write_fastq`` wrote, in its order."""
    from pyarrow import fs

    system, inner = file_system(folder)
    head = "" if is_local(folder) else folder[: len(folder) - len(inner)]
    found = system.get_file_info(fs.FileSelector(inner))
    return [head + f.path for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[:1] not in "._"]

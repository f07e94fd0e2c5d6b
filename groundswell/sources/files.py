"""Files by path or URI, on the driver and on executors: a mounted folder, or whatever store the path's scheme names."""

from __future__ import annotations

import fnmatch
import glob
import posixpath

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def found(path: str, pattern: str) -> list[str]:
    """Files, sorted: the path itself, those of a folder that match ``pattern``, or those that a path with wildcards matches."""
    system, own = opened(path)
    prefix = path[: len(path) - len(own)] if "://" in path and path.endswith(own) else ""
    if isinstance(system, fs.LocalFileSystem):
        prefix = ""
    if any(c in own for c in "*?["):
        if isinstance(system, fs.LocalFileSystem):
            return sorted(glob.glob(own))
        folder, pattern = posixpath.split(own)
    else:
        info = system.get_file_info(own)
        if info.type == fs.FileType.File:
            return [path if prefix else own]
        if info.type == fs.FileType.NotFound:
            return []
        folder = own
    return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def read(path: str, offset: int = 0, size: int | None = None) -> bytes:
    system, own = opened(path)
    with system.open_input_file(own) as f:
        size = max(0, f.size() - offset) if size is None else size
        return f.read_at(size, offset)


def write(path: str, parts) -> None:
    """The parts one after the other, under another name until the file is whole."""
    system, own = opened(path)
    folder = posixpath.dirname(own)
    if folder:
        system.create_dir(folder, recursive=True)
    with system.open_output_stream(own + ".part") as f:
        for part in parts:
            f.write(part)
    system.move(own + ".part", own)

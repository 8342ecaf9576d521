"""Files on whatever file system a path names, for code that runs on executors."""

from __future__ import annotations

import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    local = re.match(r"file:/*(/.*)", path)
    if local:
        return fs.LocalFileSystem(), local[1]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the data files below a folder, in order of name."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    base = inner.rstrip("/")
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(base) + 1 :].split("/"))
    return sorted((path.rstrip("/") + x.path[len(base) :], x.size) for x in found if x.type == fs.FileType.File and not hidden(x.path))

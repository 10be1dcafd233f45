"""Files by plain path or by address, of any file system that Arrow opens."""

from __future__ import annotations

import os
import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (scheme://...), and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][\w+.-]*:/", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def below(root: str, path: str) -> str:
    """The path of a file in a folder, without dots. One that leaves the folder, by dots or a local link, is an error."""
    system, top = opened(root)
    at = os.path.normpath(os.path.join(top, path))
    real = os.path.realpath if isinstance(system, fs.LocalFileSystem) else os.path.normpath
    if at == top.rstrip("/") or os.path.commonpath([real(top), real(at)]) != real(top):
        raise ValueError(f"{path!r} leaves the folder")
    return os.path.relpath(at, top)

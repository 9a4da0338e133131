"""Files of a tree in a store that pyarrow knows (local or shared folders, HDFS, S3, ...)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyarrow import fs


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path inside of it."""
    plain = re.sub(r"^file:/+", "/", root)
    store, at = fs.FileSystem.from_uri(plain if "://" in plain else os.path.abspath(plain))
    return store, at.rstrip("/")


def listed(root: str) -> Iterator[tuple[str, int, int]]:
    """(path below the root, bytes, microseconds of its last change) of every file that is physically below the
    root: links, to files and to folders, are not followed. Folders that go or can't be read are passed over."""
    store, at = opened(root)
    if not isinstance(store, fs.LocalFileSystem):  # stores without links
        for info in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
            if info.is_file:
                yield info.path[len(at) + 1 :], info.size, (info.mtime_ns or 0) // 1000
        return
    todo = [""]
    while todo:
        below = todo.pop()
        try:
            entries = sorted(os.scandir(f"{at}/{below}"), key=lambda e: e.name)
        except OSError:
            continue
        for entry in entries:
            try:
                if entry.is_dir(follow_symlinks=False):
                    todo.append(f"{below}{entry.name}/")
                elif entry.is_file(follow_symlinks=False):
                    stat = entry.stat(follow_symlinks=False)
                    yield below + entry.name, stat.st_size, stat.st_mtime_ns // 1000
            except OSError:
                continue

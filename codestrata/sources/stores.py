"""Files in any store, opened from tasks."""

from __future__ import annotations

import re


def opened(path: str):
    """The file system of a URI or a local path, and the path in it."""
    from pyarrow import fs

    if re.match(r"[a-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path

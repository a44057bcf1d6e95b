"""Files that tasks write and read themselves, by the forms of path that Spark uses."""

from __future__ import annotations

import re

from pyarrow import fs

# Other names of a scheme, and the schemes that pyarrow opens.
_SAME = {"s3a": "s3", "s3n": "s3"}
_KNOWN = frozenset(["file", "s3", "gs", "gcs", "hdfs", "viewfs", "abfs", "abfss"])


def reachable(uri: str) -> str:
    """The path as pyarrow names it.

    ``s3a`` and ``s3n`` become ``s3``; a path without a scheme stays. A scheme that pyarrow has no file
    system for raises ValueError, so a job on it fails before it starts.
    """
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", uri)
    if not found:
        return uri
    scheme = _SAME.get(found[1].lower(), found[1].lower())
    if scheme not in _KNOWN:
        raise ValueError(f"{uri}: tasks cannot open {scheme}: paths; set spark.checkpoint.dir to one of {', '.join(sorted(_KNOWN))}, or to a mounted folder")
    return scheme + uri[found.end(1) :]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and its name there."""
    return fs.FileSystem.from_uri(reachable(uri))

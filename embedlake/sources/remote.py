"""Opening a file by URI inside a task."""

from __future__ import annotations

import re

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark prints it; names stay verbatim."""
    scheme = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if scheme is None or scheme.group(1) == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def open_for_reading(uri: str):
    """Seekable file object; nothing is read ahead."""
    system, path = filesystem(uri)
    return system.open_input_file(path)


def open_for_writing(uri: str):
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)

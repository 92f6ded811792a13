"""Binary files in the shared folder, written by tasks.

Every attempt writes a file of its own name; only the rows that a task returns (stored by Spark's committer) name the
files that count, so retries, speculation and lost executors leave no double or half file behind in a result.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str, ending: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{ending}"


def create(uri: str):
    system, path = located(uri)
    return system.open_output_stream(path, compression=None)


def open_file(uri: str):
    """Random access."""
    system, path = located(uri)
    return system.open_input_file(path)


def open_stream(uri: str):
    system, path = located(uri)
    return system.open_input_stream(path, compression=None)

"""Files in the shared folder, for tasks that write or read them outside of Spark's tables."""

from __future__ import annotations

import contextlib
from typing import BinaryIO
from urllib.parse import urlsplit

from pyarrow import fs


class Store:
    """A folder by its URI, on a local or shared disk or whatever pyarrow reaches."""

    def __init__(self, uri: str) -> None:
        parts = urlsplit(uri)
        if parts.scheme in ("", "file"):
            self.files, self.root = fs.LocalFileSystem(), parts.path
        else:
            self.files, self.root = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.root, recursive=True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str) -> BinaryIO:
        return self.files.open_output_stream(self.path(name), compression=None)

    def stream(self, name: str) -> BinaryIO:
        return self.files.open_input_stream(self.path(name), compression=None)

    def seekable(self, name: str) -> BinaryIO:
        return self.files.open_input_file(self.path(name))

    def rename(self, old: str, new: str) -> None:
        self.files.move(self.path(old), self.path(new))

    def drop(self, name: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            self.files.delete_file(self.path(name))

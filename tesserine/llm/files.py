"""Files that executors write and read by range, in whatever store the shared folder is in."""

from __future__ import annotations

import uuid

import pyarrow.fs as fs

#: Bytes read at once when ranges follow each other.
WINDOW = 4 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(folder: str, suffix: str):
    """A new file under a name that no other attempt of a task takes: (uri, stream). Only files named in a committed table count."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path)


def remove_folder(uri: str) -> None:
    system, path = opened(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


class Ranges:
    """Reads byte ranges of one file after another; neighbouring ranges share one request."""

    def __init__(self) -> None:
        self.uri, self.file, self.size, self.at, self.held = None, None, 0, 0, b""

    def open(self, uri: str) -> None:
        if uri != self.uri:
            self.close()
            system, path = opened(uri)
            self.file, self.uri = system.open_input_file(path), uri
            self.size, self.at, self.held = self.file.size(), 0, b""

    def read(self, uri: str, offset: int, length: int) -> bytes:
        self.open(uri)
        if not self.at <= offset <= offset + length <= self.at + len(self.held):
            if offset < 0 or offset + length > self.size:
                raise ValueError(f"{uri} has no bytes {offset} to {offset + length}")
            self.held = self.file.read_at(min(max(length, WINDOW), self.size - offset), offset)
            self.at = offset
        return self.held[offset - self.at : offset - self.at + length]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri = self.file = None

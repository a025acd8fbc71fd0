"""Byte ranges of files on local or remote storage, through one client."""

from __future__ import annotations

import posixpath
import re


def split_uri(path: str) -> tuple[str | None, str]:
    """(scheme and authority, path inside); a plain path or file: is local."""
    found = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)$", path)
    if not found or found.group(1) == "file":
        return None, re.sub(r"^file:(//[^/]*)?", "", path)
    return f"{found.group(1)}:{found.group(2) or ''}", found.group(3)


class Store:
    """Files by path.  One client per scheme and authority; `taken` counts the bytes that were read."""

    def __init__(self):
        self.clients, self.taken = {}, 0

    def client(self, path: str):
        """(file system, path on it)."""
        from pyarrow import fs

        where, inside = split_uri(path)
        if where not in self.clients:
            self.clients[where] = fs.LocalFileSystem() if where is None else fs.FileSystem.from_uri(path)[0]
        known = self.clients[where]
        if where is not None and known.type_name in ("s3", "gcs", "abfs"):
            inside = posixpath.join(where.split("//", 1)[-1], inside.lstrip("/"))
        return known, inside

    def open(self, path: str) -> "File":
        return File(self, path)

    def create(self, path: str):
        """A new file, open for writing; folders on the way are made."""
        client, inside = self.client(path)
        client.create_dir(posixpath.dirname(inside), recursive=True)
        return client.open_output_stream(inside)

    def exists(self, path: str) -> bool:
        from pyarrow import fs

        client, inside = self.client(path)
        return client.get_file_info(inside).type != fs.FileType.NotFound

    def move(self, path: str, to: str) -> None:
        client, inside = self.client(path)
        target = self.client(to)[1]
        client.create_dir(posixpath.dirname(target), recursive=True)
        client.move(inside, target)

    def files(self, path: str) -> list[tuple[str, int]]:
        """(path relative to this one, size) of all files below."""
        from pyarrow import fs

        client, inside = self.client(path)
        listed = client.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
        return sorted((posixpath.relpath(f.path, inside), f.size) for f in listed if f.type == fs.FileType.File)

    def drop_folder(self, path: str) -> None:
        if self.exists(path):
            client, inside = self.client(path)
            client.delete_dir(inside)


class File:
    """One open file: its size, and any range of its bytes."""

    def __init__(self, store: Store, path: str):
        client, inside = store.client(path)
        self.store, self.handle = store, client.open_input_file(inside)
        self.size = self.handle.size()

    def at(self, start: int, count: int) -> bytes:
        count = max(0, min(count, self.size - start))
        data = self.handle.read_at(count, start) if count else b""
        self.store.taken += len(data)
        return data

    def blocks(self, start: int, stop: int, size: int):
        """(place, bytes) of consecutive blocks of [start, stop)."""
        for at in range(start, stop, size):
            yield at, self.at(at, min(size, stop - at))

    def close(self) -> None:
        self.handle.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

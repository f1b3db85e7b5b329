"""Files on every file system that Arrow reaches, by path or URI: patterns, sizes and ranges of bytes, in the driver and in tasks alike."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class Stored:
    path: str
    size: int
    mtime_ns: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_at(paths: list[str]) -> list[Stored]:
    """Size and time of each file, asked for together; an error if one is missing."""
    by_store: dict[str, list[int]] = {}
    for i, path in enumerate(paths):
        by_store.setdefault(path.split("://", 1)[0] if "://" in path else "", []).append(i)
    found: dict[int, Stored] = {}
    for own in by_store.values():
        store = located(paths[own[0]])[0]
        for i, info in zip(own, store.get_file_info([located(paths[i])[1] for i in own])):
            if info.type != fs.FileType.File:
                raise FileNotFoundError(paths[i])
            found[i] = Stored(paths[i], info.size, info.mtime_ns or 0)
    return [found[i] for i in range(len(paths))]


def exists(path: str) -> bool:
    store, inner = located(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def matching(pattern: str) -> list[Stored]:
    """Files that a pattern (*, ? and [] in any step of the path) matches, in order of their paths; the store is listed from the first such step on."""
    store, inner = located(pattern)
    head = pattern[: len(pattern) - len(inner)] if pattern.endswith(inner) else ""
    steps = inner.split("/")
    wild = [i for i, s in enumerate(steps) if any(c in s for c in "*?[")]
    if not wild:
        info = store.get_file_info(inner)
        return [Stored(pattern, info.size, info.mtime_ns or 0)] if info.type == fs.FileType.File else []
    base = "/".join(steps[: wild[0]]) or ("/" if inner.startswith("/") else ".")
    told = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=wild[0] < len(steps) - 1))
    fits = lambda p: len(p) == len(steps) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(p, steps))
    own = [(i.path.removeprefix("./") if base == "." else i.path, i) for i in told if i.type == fs.FileType.File]
    return sorted((Stored(head + p, i.size, i.mtime_ns or 0) for p, i in own if fits(p.split("/"))), key=lambda s: s.path)


class Reader:
    """Ranges of files; the file read last stays open.  ``fetched``: bytes read so far."""

    def __init__(self) -> None:
        self.fetched = 0
        self._path, self._file = "", None

    def fetch(self, path: str, at: int, length: int) -> bytes:
        """Exactly these bytes, or an error."""
        if path != self._path:
            self.close()
            store, inner = located(path)
            self._file, self._path = store.open_input_file(inner), path
        got = self._file.read_at(length, at)
        self.fetched += len(got)
        if len(got) != length:
            raise OSError(f"{path}: {len(got)} of {length} bytes at {at}")
        return got

    def close(self) -> None:
        if self._file:
            self._file.close()
        self._path, self._file = "", None


def read(path: str) -> bytes:
    """A small file as a whole."""
    store, inner = located(path)
    with store.open_input_stream(inner) as f:
        return f.read()

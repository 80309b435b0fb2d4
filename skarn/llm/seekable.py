"""Seekable Zstandard files: independent frames, then a seek table in a skippable frame at the end.

The table is the published seekable format: per frame its compressed size, decompressed size and the low 32 bits of
the XXH64 of its content; then the number of frames, a flag byte and a magic number. Application data (a directory of
record keys) may precede the table in a skippable frame of its own, which plain Zstandard readers pass over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyarrow import fs

#: Fixed values of the format.
SEEK_MAGIC = 0x8F92EAB1
SKIP_SEEK, SKIP_OWN = 0x184D2A5E, 0x184D2A50
CHECKSUMS = 0x80


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends frames under a temporary name; ``close`` puts the file in place, so half a file is never seen."""

    def __init__(self, uri: str, level: int = 3):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.zip = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.size = 0

    def frame(self, content: bytes) -> int:
        """The number of the frame that now holds ``content``."""
        packed = self.zip.compress(content)
        self.out.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.size += len(packed)
        return len(self.entries) - 1

    def close(self, directory: bytes = b"") -> None:
        packed = self.zip.compress(directory)
        self.out.write(struct.pack("<II", SKIP_OWN, len(packed)) + packed)
        table = np.array(self.entries, dtype="<u4").reshape(-1, 3).tobytes()
        self.out.write(struct.pack("<II", SKIP_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC))
        self.out.close()
        self.fs.move(self.path + ".part", self.path)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.path + ".part")


class Reader:
    """Reads the table and the directory, and then only the frames asked for."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        if size < 9:
            raise ValueError(f"{path} is too short for a seek table")
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS or 17 + 12 * count > size:
            raise ValueError(f"{path} has no seek table with checksums at its end")
        self.table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.unzip = zstandard.ZstdDecompressor()
        end, last = int(self.at[-1]), size - 17 - 12 * count
        if end + 8 > last:
            raise ValueError(f"{path}: the seek table does not fit the file")
        kind, length = struct.unpack("<II", self.file.read_at(8, end))
        if kind != SKIP_OWN or end + 8 + length != last:
            raise ValueError(f"{path} has no directory before its seek table")
        self.directory = self.unzip.decompress(self.file.read_at(length, end + 8))

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, k: int) -> bytes:
        return self._content(k, self.file.read_at(int(self.table[k, 0]), int(self.at[k])))

    def frames(self, step: int = 4 << 20) -> Iterator[bytes]:
        """All contents in turn, read ``step`` bytes at a time."""
        low = 0
        while low < len(self):
            high = max(low + 1, int(np.searchsorted(self.at, self.at[low] + step, side="right")) - 1)
            data = memoryview(self.file.read_at(int(self.at[high] - self.at[low]), int(self.at[low])))
            for k in range(low, high):
                yield self._content(k, data[self.at[k] - self.at[low] : self.at[k + 1] - self.at[low]])
            low = high

    def _content(self, k: int, packed) -> bytes:
        content = self.unzip.decompress(packed, max_output_size=max(1, int(self.table[k, 1])))
        if len(content) != self.table[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def close(self) -> None:
        self.file.close()

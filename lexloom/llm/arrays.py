"""Arrays as files in the shared folder, and sorted keys with counts as compact blocks for shuffles."""

from __future__ import annotations

import io
import os
import uuid
from collections import OrderedDict

import numpy as np
import zstandard

from ..session import local_path, makedirs


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes folder/name.npy at once or not at all; a task that runs again replaces it by the same."""
    path = local_path(folder)
    if path is None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        buffer = io.BytesIO()
        np.save(buffer, array)
        with store.open_output_stream(f"{root}/{name}.npy") as f:
            f.write(buffer.getvalue())
        return
    makedirs(folder)
    own = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(own, array)
    os.replace(own, f"{path}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """Memory-mapped where the shared folder is mounted, else read."""
    path = local_path(folder)
    if path is None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{root}/{name}.npy") as f:
            return np.load(io.BytesIO(f.read()))
    return np.load(f"{path}/{name}.npy", mmap_mode="r")


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return counts.astype(np.uint32 if counts.size and counts.max() < 1 << 32 else np.uint64)


class Shelf:
    """A folder's arrays, opened as they are needed; where they aren't mapped, some are kept, of so many bytes in all."""

    def __init__(self, folder: str, most: int = 128 << 20):
        self.folder, self.most, self.mapped, self.held, self.size = folder, most, {}, OrderedDict(), 0

    def load(self, name: str) -> np.ndarray:
        if name in self.mapped:
            return self.mapped[name]
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        found = load(self.folder, name)
        if isinstance(found, np.memmap):
            self.mapped[name] = found
            return found
        self.held[name] = found
        self.size += found.nbytes
        while self.size > self.most and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return found


def exists(folder: str, name: str) -> bool:
    path = local_path(folder)
    if path is None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        return store.get_file_info(f"{root}/{name}.npy").type == fs.FileType.File
    return os.path.exists(f"{path}/{name}.npy")


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys and columns, all as uint64; differences and counts are small, so their high bytes vanish."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(len(keys), -1).T).tobytes() for a in (steps, *values)]
    return np.array([len(keys), len(values)], "<u8").tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpack(block: bytes, dtype=np.int64) -> tuple[np.ndarray, ...]:
    """The keys, and the columns as dtype."""
    n, m = np.frombuffer(block[:16], "<u8").tolist()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[16:], max_output_size=8 * n * (1 + m)) if n else b"", np.uint8)
    steps, *values = (np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view("<u8").ravel() for i in range(1 + m))
    return np.cumsum(steps, dtype=np.uint64), *(v.astype(dtype) for v in values)


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The distinct keys of all parts in order, and each column's sums (as int64)."""
    if not parts:
        return (np.zeros(0, np.uint64),)
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    columns = [np.concatenate([p[i] for p in parts]).astype(np.int64)[order] for i in range(1, len(parts[0]))]
    return keys[starts], *(np.add.reduceat(c, starts) if len(starts) else c for c in columns)

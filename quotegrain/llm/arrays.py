"""Sorted hash arrays: tables keyed by 64-bit hashes, one file per shard in the shared folder, memory-mapped by workers.

The shard of a key is its leading ``bits``. A shard keeps the next 48 bits of its keys in order, as one array of 32 and one of 16,
and a column per value in the smallest type that holds it. With the shards a few million entries large, a key that was never
stored is taken for a stored one about once in 10^8 lookups, at any number of shards. Tasks write a file under a name of
their own and rename it, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import json
import mmap
import uuid

import numpy as np
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import SparkSession

from quotegrain.session import shared_dir

#: Files that one reader keeps mapped.
OPEN = 512


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, as a URI."""
    uri = f"{shared_dir(spark).rstrip('/')}/quotegrain-llm/{name}-{uuid.uuid4().hex}"
    return uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"


def _place(uri: str):
    return pafs.FileSystem.from_uri(uri.replace("file:///", "/") if uri.startswith("file:///") else uri)


def smallest(column: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in the smallest unsigned type."""
    top = int(column.max()) if len(column) else 0
    return column.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length as compressed bytes."""
    head = json.dumps([len(columns[0]), [c.dtype.str for c in columns]]).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(head).to_bytes(4, "little"), head, *(c.tobytes() for c in columns)]))


def unpack(data: bytes) -> list[np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(plain[:4], "little")
    n, kinds = json.loads(plain[4:at])
    out = []
    for kind in kinds:
        out.append(np.frombuffer(plain, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _halves(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rest = keys << np.uint64(bits)
    return (rest >> np.uint64(32)).astype(np.uint32), ((rest >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)


def save(folder: str, table: str, shard: int, bits: int, keys: np.ndarray, columns: dict[str, np.ndarray]) -> None:
    """Write one shard; ``keys`` ascend. Columns of zeros are left out."""
    high, low = _halves(keys, bits)
    first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(high) else np.zeros(0, np.int64)
    run = int(np.diff(np.r_[first, len(high)]).max()) if len(high) else 0
    parts = {"_high": high, "_low": low} | {c: smallest(v) for c, v in columns.items() if v.any()}
    at, fields = 0, []
    for name, column in parts.items():
        fields.append([name, column.dtype.str, at])
        at += -(-column.nbytes // 8) * 8
    head = json.dumps({"n": len(keys), "run": run, "fields": fields}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    whole = [len(head).to_bytes(8, "little"), head, *(column.tobytes() + b"\0" * (-column.nbytes % 8) for column in parts.values())]
    put(folder, f"{table}-{shard}", b"".join(whole))


def put(folder: str, name: str, data: bytes) -> None:
    """Write one file whole; of a task that runs twice the last one stays."""
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{path}/{name}")


def get(folder: str, name: str) -> bytes:
    fs, path = _place(folder)
    with fs.open_input_file(f"{path}/{name}") as file:
        return file.read()


class HashArrays:
    """Lookups in the table that ``save`` wrote; shards without a file are empty."""

    def __init__(self, folder: str, table: str, bits: int):
        self.fs, self.path = _place(folder)
        self.table, self.bits = table, bits
        self.shards: dict[int, dict | None] = {}

    def _shard(self, k: int) -> dict | None:
        if k not in self.shards:
            if len(self.shards) >= OPEN:
                self.shards.pop(next(iter(self.shards)))
            self.shards[k] = self._load(f"{self.path}/{self.table}-{k}")
        return self.shards[k]

    def _load(self, path: str) -> dict | None:
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                with open(path, "rb") as file:
                    data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
            else:  # a store without a mount cannot be mapped
                with self.fs.open_input_file(path) as file:
                    data = file.read()
        except FileNotFoundError:
            return None
        start = 8 + int.from_bytes(data[:8], "little")
        head = json.loads(data[8:start])
        return {"run": head["run"]} | {name: np.frombuffer(data, kind, head["n"], start + at) for name, kind, at in head["fields"]}

    def find(self, keys: np.ndarray, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is stored, and its value in each column as a double, zero where it is not."""
        asked, back = np.unique(keys, return_inverse=True)
        shards = shard_of(asked, self.bits)
        high, low = _halves(asked, self.bits)
        found = np.zeros(len(asked), bool)
        values = [np.zeros(len(asked)) for _ in columns]
        first = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(asked) else np.zeros(0, np.int64)
        for a, b in zip(first.tolist(), np.r_[first[1:], len(asked)].tolist(), strict=False):
            held = self._shard(int(shards[a]))
            if held is None or not len(held["_high"]):
                continue
            at = np.searchsorted(held["_high"], high[a:b])
            place = np.full(b - a, -1)
            for step in range(held["run"]):
                k = np.minimum(at + step, len(held["_high"]) - 1)
                place = np.where((place < 0) & (held["_high"][k] == high[a:b]) & (held["_low"][k] == low[a:b]), k, place)
            hit = place >= 0
            found[a:b] = hit
            for out, name in zip(values, columns, strict=True):
                if name in held:
                    out[a:b][hit] = held[name][place[hit]]
        return found[back], [v[back] for v in values]

"""Shared pieces: the shared work folder, Arrow text slices, word splitting and vectorised hashes.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D) everywhere in this package.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
SLICE_BYTES = 2 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rowloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{work_dir(spark)}/rowloom-{uuid.uuid4().hex}-{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may be gone already; the folder is then left to the cluster's own clean-up
            pass

    atexit.register(remove)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """Files in one folder that all executors share: written whole under a temporary name and renamed, so that a retry writes the same file again."""

    def __init__(self, uri: str):
        self.uri = uri
        parts = urlparse(uri)
        self.local = parts.path if parts.scheme in ("", "file") else None

    def __reduce__(self):
        return type(self), (self.uri,)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    @contextmanager
    def writing(self, name: str):
        """A file to write to, which is there under its name once all is written."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{temporary}", "wb") as f:
                yield f
            os.replace(f"{self.local}/{temporary}", f"{self.local}/{name}")
            return
        store, root = self._store()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{temporary}") as f:
            yield f
        store.move(f"{root}/{temporary}", f"{root}/{name}")

    def reading(self, name: str):
        """A file to read from; it can be sought in."""
        if self.local is not None:
            return open(f"{self.local}/{name}", "rb")
        store, root = self._store()
        return store.open_input_file(f"{root}/{name}")


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, _, (_, offs, data) = len(column), None, column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES):
    """(rows, bytes, offsets) in pieces of about ``most`` bytes of text, so that numpy temporaries stay small.

    A longer text makes a piece of its own: texts are never cut.
    """
    for batch in batches:
        data, offsets = strings(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LONG_WORD = 256  # bytes from which words are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits (64-bit)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Words of several texts: byte ranges, XXH64 hashes, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[self.data]
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        np.logical_not(inside[:-1], out=before[1:])
        self.start = np.flatnonzero(inside & (before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1:] = True
        np.logical_not(inside[1:], out=after[:-1])
        self.end = np.flatnonzero(inside & (after | cut[1:])) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        if hashes:
            self.hash = word_hashes(self.data, self.start, self.end - self.start)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every k-word window that lies within one text."""
        if len(self.start) < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        m = len(self.start) - k + 1
        h = np.zeros(m, U64)
        for i in range(k):
            h = h * U64(0xD6E8FEB86659FD93) + self.hash[i : i + m]
        owner = self.text_of()
        ok = np.flatnonzero(owner[:m] == owner[k - 1 :])
        return ok, mix(h[ok])

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts with one space between words: bytes, and each word's start and end there."""
        keep = self.inside.copy()
        keep[self.end[self.end < len(keep)]] = True
        place = np.cumsum(keep) - 1
        out = self.data[keep]
        out[_SPACE[out]] = 32
        return out, place[self.start], place[self.end - 1] + 1


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of ``data`` at once."""
    with np.errstate(over="ignore"):
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        four = np.ndarray((len(data) - 7,), "<u4", data, strides=(1,))
        seed = U64(seed)
        h = np.full(len(start), seed + _P5, U64)
        at, stripes = start.copy(), size // 32
        big = np.flatnonzero(stripes)
        if len(big):
            big = big[np.argsort(-stripes[big], kind="stable")]
            left = stripes[big]
            v = [np.full(len(big), x, U64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            for s in range(int(left[0])):
                m = int(np.searchsorted(-left, -s, "left"))
                p = at[big[:m]] + 32 * s
                for i in range(4):
                    v[i][:m] = _rot(v[i][:m] + eight[p + 8 * i] * _P2, 31) * _P1
            x = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for y in v:
                x = (x ^ (_rot(y * _P2, 31) * _P1)) * _P1 + _P4
            h[big] = x
            at[big] += 32 * left
        h += size.astype(U64)
        rest = size % 32
        for lane in range(3):
            w = np.flatnonzero(rest >= 8 * (lane + 1))
            if len(w):
                h[w] = _rot(h[w] ^ (_rot(eight[at[w]] * _P2, 31) * _P1), 27) * _P1 + _P4
                at[w] += 8
        w = np.flatnonzero(rest % 8 >= 4)
        h[w] = _rot(h[w] ^ (four[at[w]].astype(U64) * _P1), 23) * _P2 + _P3
        at[w] += 4
        for k in range(3):
            w = np.flatnonzero(rest % 4 > k)
            h[w] = _rot(h[w] ^ (data[at[w] + k].astype(U64) * _P5), 11) * _P1
        h ^= h >> U64(33)
        h *= _P2
        h ^= h >> U64(29)
        h *= _P3
        return h ^ (h >> U64(32))


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each word."""
    long = np.flatnonzero(size > LONG_WORD)
    if not len(long):
        return xxh64(data, start, size, 0)
    import xxhash

    out = xxh64(data, start, np.where(size > LONG_WORD, 0, size), 0)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return out


def bits_per_text(h: np.ndarray, count: np.ndarray, longest: int = 60_000) -> np.ndarray:
    """How often each of 64 bits is set in each text's hashes (``count`` hashes a text, in order): n x 64.

    Sums four 16-bit lanes at once, over runs short enough not to overflow.
    """
    out = np.zeros((len(count), 64), np.int64)
    filled = np.flatnonzero(count)
    if not len(filled):
        return out
    begin = np.cumsum(count) - count
    if int(count.max()) <= longest:
        cuts, owner = begin[filled], filled
    else:
        parts = [np.arange(begin[i], begin[i] + count[i], longest) for i in filled]
        cuts, owner = np.concatenate(parts), np.repeat(filled, [len(p) for p in parts])
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        for half in range(2):
            lanes = np.add.reduceat(_LANES[half][raw[:, byte]], cuts)
            for i in range(4):
                np.add.at(out[:, byte * 8 + half * 4 + i], owner, ((lanes >> U64(16 * i)) & U64(0xFFFF)).astype(np.int64))
    return out


_LANES = [np.array([sum(((b >> (4 * half + i)) & 1) << (16 * i) for i in range(4)) for b in range(256)], U64) for half in range(2)]

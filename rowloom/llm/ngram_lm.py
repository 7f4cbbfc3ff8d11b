"""An n-gram model as an Elias-Fano trie in memory-mapped files, trained and queried in parallel. Its order is 3 by default.

Level 1 holds the words: their 64-bit hashes in order (Elias-Fano) and exact counts. A word's number is its place in
that order. Level k holds the last words of all k-grams, in the order of their contexts: a k-gram's context is the
number of its first k - 1 words, their place in level k - 1. Monotone pointers (Elias-Fano) give a context's range;
its successors' numbers, ascending, are stored relative to the context (each plus one on top of the last value before the
range), which makes the whole level one increasing Elias-Fano sequence; a successor is found by searching for
context base plus number plus one within the range, and its place there is the number of the longer n-gram, with which the
search goes on. With each goes the 8-bit code of its discounted probability, and with each context its quantised back-off
weight. Levels are cut into shards, level 1 by ranges of hashes, the others by ranges of contexts, one file each.

Probability, from words up: p(w) = (n(w) + A) / (N + A * (V + 1)); p(w | c) = max(n(c, w) - D, 0) / n(c) + D * types(c) / n(c) *
p(w | c without its first word); for a context never seen, the latter alone. The end token is a token of its own; one
stands before each text's first word.

Counts cover all training documents: each task counts its slices (n-grams by numbers within the slice, so that no key can
overflow), counts travel as packed arrays by shard (differences in byte planes, zstandard), and each shard is merged
and written by one task (to a temporary name, then renamed: a retry writes the same file again). The number of shards
follows from the bytes of text. Model files lie in the shared folder; where that is not a mounted file system each worker
fetches the shards it needs to its own temporary folder. Nothing but two numbers a shard and level comes to the driver.

Edge cases: null and blank texts have the end token only; a null id counts as the empty string (held out, as its CRC-32
is 0); with no training text all words are unknown; equal rows count and score each; extra columns do not matter.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Folder, Words, materialise, scratch, slices

A, DISCOUNT = 0.1, 0.75
END = U64(0x5EED0E2D5EED0E2D)  # the end token's hash
ORDER = 3
GATHER_BYTES = 8 << 20
SHARD_BYTES = 16 << 20  # bytes of text a shard
BLOBS = "shard int, blob binary"


# ---- Elias-Fano

_ONES, _FIVES, _THREES, _FIFTEENS, _TOPS = (U64(x * 0x0101010101010101) for x in (0x01, 0x55, 0x33, 0x0F, 0x80))
_PLACES = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], U64).ravel()  # of the k-th one of a byte


def _trailing_zeros(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x & (~x + U64(1))) - U64(1))


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in arrays["meta"])
        self.high, self.low, self.ones, self.zeros = (arrays[k] for k in ("high", "low", "ones", "zeros"))

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high_part = (values >> U64(low_bits)).astype(np.int64)
        size = n + (top >> low_bits) + 2 + 64
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high_part + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        zeros = (np.arange(len(ones), dtype=np.int64) * 64 - ones).astype(np.uint32)
        low = np.zeros(n * low_bits // 64 + 2, U64)
        if low_bits and n:
            rest = values & U64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, rest << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (U64(64) - shift[over]))
        return {"meta": np.array([n, low_bits], np.int64), "high": high, "low": low, "ones": ones, "zeros": zeros}

    def _select(self, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero, of the high bits."""
        word = np.searchsorted(counts, k.astype(np.uint32), "right") - 1
        bits = self.high[np.minimum(word, len(self.high) - 1)]
        if flip:
            bits = ~bits
        left = (k - counts[word].astype(np.int64)).astype(U64)
        # Ones a byte, then ones up to each byte, then how many bytes have no more than ``left`` of them.
        ones = bits - ((bits >> U64(1)) & _FIVES)
        ones = (ones & _THREES) + ((ones >> U64(2)) & _THREES)
        upto = ((ones + (ones >> U64(4))) & _FIFTEENS) * _ONES
        shift = np.bitwise_count(((left * _ONES) | _TOPS) - upto & _TOPS).astype(U64) << U64(3)
        rank = left - (((upto << U64(8)) >> shift) & U64(255))
        in_byte = _PLACES[((bits >> shift & U64(255)) << U64(3) | rank).astype(np.int64)]
        return word * 64 + (shift + in_byte).astype(np.int64)

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 64 high bits from each place on; the last word of the high bits is spare."""
        word, shift = at >> 6, (at & 63).astype(U64)
        return (self.high[word] >> shift) | ((self.high[np.minimum(word + 1, len(self.high) - 1)] << U64(1)) << (U64(63) - shift))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U64)
        value = self.low[word] >> shift
        more = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return (value | more) & U64((1 << self.low_bits) - 1)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i + 1."""
        at = self._select(self.ones, i, False)
        window = self._window(at + 1)
        after = at + 1 + _trailing_zeros(window).astype(np.int64)
        far = np.flatnonzero(window == 0)
        after[far] = self._select(self.ones, i[far] + 1, False)
        low = U64(self.low_bits)
        return ((at - i).astype(U64) << low) | self._low(i), ((after - i - 1).astype(U64) << low) | self._low(i + 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(self.ones, i, False) - i).astype(U64) << U64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """A place of each value, or -1. Values must be strictly increasing for the place to be the only one."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        bucket = (x >> U64(self.low_bits)).astype(np.int64)
        last = len(self.high) * 64 - self.n  # zeros in all
        ask = np.flatnonzero((bucket >= 0) & (bucket < last - 1))
        bucket = bucket[ask]
        begin = np.where(bucket > 0, self._select(self.zeros, np.maximum(bucket - 1, 0), True) + 1, 0)
        window = ~self._window(begin)  # ones from there on are the bucket
        lo = begin - bucket
        hi = lo + _trailing_zeros(window).astype(np.int64)
        far = np.flatnonzero(window == 0)
        hi[far] = self._select(self.zeros, bucket[far], True) - bucket[far]
        rest = x[ask] & U64((1 << self.low_bits) - 1)
        end = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < rest[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        near = np.flatnonzero(lo < end)
        hit = near[self._low(lo[near]) == rest[near]]
        out[ask[hit]] = lo[hit]
        return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their code book (means of up to 256 equally filled bins)."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256)
    values, back, times = np.unique(x, return_inverse=True, return_counts=True)
    if len(values) <= 256:
        return back.astype(np.uint8), np.pad(values, (0, 256 - len(values)))
    bin_of = np.minimum((np.cumsum(times) - times) * 256 // len(x), 255)
    weight, total = np.bincount(bin_of, times, 256), np.bincount(bin_of, times * values, 256)
    return bin_of[back].astype(np.uint8), total / np.maximum(weight, 1)


# ---- files

class Store(Folder):
    """Model files in one folder, read by memory map."""

    def __init__(self, uri: str):
        super().__init__(uri)
        self.maps: dict[str, dict[str, np.ndarray]] = {}

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        head, at, parts = {}, 0, []
        for k, a in arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            head[k] = [a.dtype.str, at, len(a)]
            raw += b"\0" * (-len(raw) % 8)
            parts.append(raw)
            at += len(raw)
        first = json.dumps(head).encode()
        first += b" " * (-len(first) % 8)
        with self.writing(name) as f:
            f.write(len(first).to_bytes(8, "little") + first + b"".join(parts))

    def get(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.maps:
            if self.local is not None:
                with open(f"{self.local}/{name}", "rb") as f:
                    whole = np.frombuffer(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ, trackfd=False), np.uint8)
            else:
                with tempfile.TemporaryFile() as f, self.reading(name) as source:
                    while piece := source.read(1 << 24):
                        f.write(piece)
                    f.flush()
                    whole = np.memmap(f, np.uint8, "r")  # the file has no name, so it goes with the map
            size = int(whole[:8].view("<u8")[0])
            head = json.loads(whole[8 : 8 + size].tobytes())
            body = whole[8 + size :]
            self.maps[name] = {k: body[at : at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in head.items()}
        return self.maps[name]


class Model:
    """The trie's shards. ``bounds[k]``: the contexts at which shards of level k + 2 begin; ``first[k]``: each shard's first n-gram number in level k + 1."""

    def __init__(self, store: Store, first: list[int], n: int):
        self.store, self.n = store, n
        self.first = [np.array(first, np.int64)]
        self.bounds: list[np.ndarray] = []
        self.shards, self.v = len(first) - 1, first[-1]

    def add_level(self, bounds: np.ndarray, first: list[int]) -> None:
        self.bounds.append(bounds)
        self.first.append(np.array(first, np.int64))

    def by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Runs of equal shard of an ascending array."""
        ends = np.flatnonzero(np.concatenate([shard[1:] != shard[:-1], [True]])) + 1 if len(shard) else []
        at = 0
        for e in ends:
            yield int(shard[at]), slice(at, int(e))
            at = int(e)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (or -1) and count of each word; hashes ascend."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, run in self.by_shard(shard_of(hashes, self.shards)):
            if self.first[0][s] == self.first[0][s + 1]:
                continue
            level = self.store.get(f"level1-{s}")
            at = EliasFano({k[5:]: v for k, v in level.items() if k.startswith("hash_")}).find(hashes[run] - shard_base(s, self.shards))
            known = np.flatnonzero(at >= 0)
            number[run.start + known] = at[known] + self.first[0][s]
            count[run.start + known] = level["counts"][at[known]]
        return number, count

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + A) / (self.n + A * (self.v + 1))

    def successors(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each n-gram (or -1), its discounted probability (or 0), and its context's back-off weight (or 1); known contexts ascend."""
        number, p, weight = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        known = np.flatnonzero(context >= 0)
        bounds, first = self.bounds[level - 2], self.first[level - 1]
        for s, run in self.by_shard(np.searchsorted(bounds, context[known], "right") - 1):
            if first[s] == first[s + 1]:
                continue
            rows = known[run]
            held = self.store.get(f"level{level}-{s}")
            pointers = EliasFano({k[4:]: v for k, v in held.items() if k.startswith("ptr_")})
            successors = EliasFano({k[5:]: v for k, v in held.items() if k.startswith("succ_")})
            distinct, back = np.unique(context[rows] - bounds[s], return_inverse=True)
            lo, hi = (x.astype(np.int64) for x in pointers.get_two(distinct))
            base = np.where(lo > 0, successors.get(np.maximum(lo - 1, 0)), U64(0))
            weight[rows] = held["weight_book"][held["weights"][distinct]][back]
            ask = np.flatnonzero(word[rows] >= 0)
            at = successors.find(base[back[ask]] + (word[rows[ask]] + 1).astype(U64))
            ok = np.flatnonzero((at >= lo[back[ask]]) & (at < hi[back[ask]]))
            p[rows[ask[ok]]] = held["p_book"][held["p_codes"][at[ok]]]
            number[rows[ask[ok]]] = at[ok] + first[s]
        return number, p, weight


def shard_base(shard: int, shards: int) -> np.uint64:
    return U64(-(-(shard << 64) // shards))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes, so that shards ascend with the hash."""
    bases = np.array([shard_base(s, shards) for s in range(shards)], U64)
    return np.searchsorted(bases, hashes, "right") - 1


# ---- training

def _gathered(batches: Iterator[pa.RecordBatch], column: str = "text"):
    """Token hashes of slices gathered to about GATHER_BYTES: (record batch pieces, tokens of each text, hashes; each text ends in END)."""
    held, size = [], 0
    for rows, data, offsets in slices(batches, column):
        words = Words(data, offsets, lower=True)
        n = words.count
        tokens = np.full(len(words.hash) + len(n), END, U64)
        tokens[np.arange(len(words.hash)) + words.text_of()] = words.hash
        held.append((rows, n + 1, tokens))
        size += len(data)
        if size >= GATHER_BYTES:
            yield [h[0] for h in held], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held, size = [], 0
    if held:
        yield [h[0] for h in held], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])


def _grams(model: Model, n: np.ndarray, tokens: np.ndarray, order: int) -> Iterator[tuple]:
    """For level 2, 3, ... of the tokens of some texts (``n`` tokens each): the places with a context, for each of them which distinct n-gram it is, and of these context and word numbers (known ones ascend).

    Whoever asks for the next level sends the numbers of this level's distinct n-grams.
    """
    distinct, local = np.unique(tokens, return_inverse=True)
    number = model.words(distinct)[0]
    begin = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(tokens))
    last, ids = local, number  # of the n-gram that ends at each token: which distinct one it is, and the distinct ones' numbers
    end = local[len(tokens) - 1]  # every text ends so, and has an end token before its first
    for level in range(2, order + 1):
        at = place[place - begin >= level - 2]
        before = np.where(at > begin[at], last[np.maximum(at - 1, 0)], end)
        key, back = np.unique((before.astype(U64) << U64(32)) | local[at].astype(U64), return_inverse=True)
        context, word = ids[(key >> U64(32)).astype(np.int64)], number[(key & U64(0xFFFFFFFF)).astype(np.int64)]
        ids = yield at, back, context, word
        last = np.zeros(len(tokens), np.int64)
        last[at] = back


def _planes(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def _from_planes(data: memoryview, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def _packed(shard: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows in order, one blob a shard: the first column's differences and the others, in byte planes, compressed. Bytes of hashes do not compress and stay as they are."""
    if not len(shard):
        return
    begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    ends = np.append(begin[1:], len(shard))
    press, blobs = zstandard.ZstdCompressor(level=1), []
    for a, b in zip(begin, ends, strict=True):
        some = [c[a:b] for c in columns]
        if some[0].dtype != U64:
            some[0] = np.diff(some[0], prepend=0)
        sizes = [8 if c.dtype == U64 else next(s for s in (1, 2, 4, 8) if int(c.max()) < 1 << 8 * s - (s == 8)) for c in some]
        blobs.append(bytes(sizes) + press.compress(b"".join(c.tobytes() if c.dtype == U64 else _planes(c, s) for c, s in zip(some, sizes, strict=True))))
    yield pa.RecordBatch.from_arrays([pa.array(shard[begin].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _unpacked(blob: bytes, n_columns: int, hashed: bool) -> list[np.ndarray]:
    sizes = blob[:n_columns]
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob[n_columns:]))
    n, at, out = len(data) // sum(sizes), 0, []
    for i, size in enumerate(sizes):
        piece = data[at : at + n * size]
        out.append(np.frombuffer(piece, U64) if hashed and i == 0 else _from_planes(piece, size))
        at += n * size
    if not hashed:
        out[0] = np.cumsum(out[0])
    return out


def _merged(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, distinct keys, counts); rows come sorted by shard, ``read`` makes keys and counts of a blob. Sums as it goes, so memory follows the distinct keys."""
    current, keys, counts, waiting = None, [], [], 0

    def total():
        k, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k)
        k, c = k[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[begin], np.add.reduceat(c, begin)

    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != current and keys:
                yield current, *total()
                keys, counts, waiting = [], [], 0
            current = shard
            k, c = read(shard, blob)
            keys.append(k)
            counts.append(c)
            waiting += len(k)
            if waiting > 2_000_000 and waiting > 2 * len(keys[0]):
                k, c = total()
                keys, counts, waiting = [k], [c], len(k)
    if keys:
        yield current, *total()


def held_out(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count all texts of ``docs`` and write the trie to a fresh folder in the shared place."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{text}`").alias("text"))
    store = Store(scratch(spark, "model"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES), 1)

    def written(count, write) -> list:
        sizes = source.mapInArrow(count, BLOBS).repartition("shard").sortWithinPartitions("shard").mapInArrow(write, "shard int, v long, n long")
        return materialise(sizes, "sizes").collect()  # two numbers a shard

    def firsts(rows: list) -> list[int]:
        found, out = {r["shard"]: r["v"] for r in rows}, [0]
        for s in range(shards):
            out.append(out[-1] + found.get(s, 0))
        return out

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tokens in _gathered(batches):
            keys, counts = np.unique(tokens, return_counts=True)
            yield from _packed(shard_of(keys, shards), [keys, counts])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches, lambda _, blob: _unpacked(blob, 2, True)):
            level = {f"hash_{k}": v for k, v in EliasFano.build(keys - shard_base(shard, shards)).items()}
            store.put(f"level1-{shard}", level | {"counts": counts})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "v": [len(keys)], "n": [int(counts.sum())]})

    found = written(count_words, write_words)
    model = Model(store, firsts(found), sum(r["n"] for r in found))
    for level in range(2, order + 1):
        # Contexts of level 2 are words, cut as these are; further ones are cut into equal ranges, whatever their first word.
        bounds = model.first[0] if level == 2 else np.linspace(0, model.first[-1][-1], shards + 1).astype(np.int64)
        model.add_level(bounds, firsts(written(*_level(model, level, bounds, order=level))))
    return model


def _level(model: Model, level: int, bounds: np.ndarray, order: int):
    """Counting and writing of one level, given those below."""
    bits = max(int(model.v).bit_length(), 1)
    if int(np.diff(bounds).max()).bit_length() + bits > 64:
        raise ValueError("a shard has too many contexts: raise spark.sql.shuffle.partitions")
    sofar = Model(model.store, model.first[0].tolist(), model.n)
    for b, f in zip(model.bounds, model.first[1:], strict=True):
        sofar.add_level(b, f.tolist())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, tokens in _gathered(batches):
            grams = _grams(sofar, n, tokens, order)
            _, back, context, word = next(grams)
            for below in range(2, level):
                _, back, context, word = grams.send(sofar.successors(below, context, word)[0])
            shard = np.searchsorted(bounds, context, "right") - 1
            yield from _packed(shard, [context, word, np.bincount(back, minlength=len(context))])

    def read(shard: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        context, word, counts = _unpacked(blob, 3, False)
        return ((context - bounds[shard]).astype(U64) << U64(bits)) | word.astype(U64), counts

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches, read):
            n = int(bounds[shard + 1] - bounds[shard])
            context = (keys >> U64(bits)).astype(np.int64)
            types, total = np.bincount(context, minlength=n), np.bincount(context, counts, n)
            codes, book = quantise((counts - DISCOUNT) / total[context])
            weights, weight_book = quantise(np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0))
            ends = np.cumsum(types)
            number = (keys & U64((1 << bits) - 1)) + U64(1)
            last = np.where(types > 0, number[np.maximum(ends - 1, 0)], U64(0))  # of each context
            base = np.cumsum(last) - last
            held = {f"ptr_{k}": v for k, v in EliasFano.build(np.concatenate([[0], ends])).items()}
            held |= {f"succ_{k}": v for k, v in EliasFano.build(base[context] + number).items()}
            sofar.store.put(f"level{level}-{shard}", held | {"p_codes": codes, "p_book": book, "weights": weights, "weight_book": weight_book})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "v": [len(keys)], "n": [int(counts.sum())]})

    return count, write


# ---- scoring

def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, and per text: n_tokens, n_known, base_score (unigrams) and score (the trie's log10 probability)."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep if c != text], F.col(f"`{text}`"))
    schema = source.select(*[F.col(f"`{c}`") for c in keep]).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    names = [f.name for f in schema]
    order = len(model.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, n, tokens in _gathered(batches, text):
            distinct, back = np.unique(tokens, return_inverse=True)
            count = model.words(distinct)[1]
            whole = model.unigram(count)[back]
            base = np.log10(whole)
            grams, numbers = _grams(model, n, tokens, order), None
            for level in range(2, order + 1):
                at, which, context, word = grams.send(numbers)
                numbers, p, weight = model.successors(level, context, word)
                whole[at] = p[which] + weight[which] * whole[at]
            begin = np.cumsum(n) - n
            sums = [np.add.reduceat(x, begin) for x in ((count > 0)[back].astype(np.int64), base, np.log10(whole))]
            kept = pa.Table.from_batches(pieces).select(keep).combine_chunks().to_batches()
            yield pa.RecordBatch.from_arrays([*(kept[0].columns if kept else []), pa.array(n), *map(pa.array, sums)], names)

    return source.mapInArrow(run, schema)


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Train on the documents not held out, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    model = train(plain.where("not held_out"), order=order)
    return score(plain, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")

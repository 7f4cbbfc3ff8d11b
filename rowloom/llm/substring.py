"""Fuzzy repeated passages: shared k-mer seeds, collinear chains with gap costs, alignment of the chained ranges.

1. Each text gives seeds at its minimizers (the smallest of ``WINDOW`` neighbouring 5-word hashes), so any 12 words in
   common share one. A minimizer gives three seeds: its 5-word hash, and that hash together with the smallest 5-word hash
   of those that begin 13 to 28 (near) or 33 to 44 (far) words after it. The pairs tie together documents that share a
   whole passage, edited or not, even if other documents hold fragments of it: fragments of up to 17 words hold no pair.
   Any 50 words in common share a near pair.
2. Occurrences of a seed are linked to its first one of all (smallest key and place), not pairwise, whatever the
   partitions. Only seeds in ``HOT`` places or more of one map slice are linked within the slice first, which leaves the
   occurrences of one document a slice to shuffle; so a seed in every document costs one document's places a slice.
   Seeds travel as packed arrays, dealt by hash to shards whose number follows from the bytes of text.
3. Matches meet again by document. Per pair of documents, matches in both orders are chained: a Fenwick tree over the
   other document's places gives the best predecessor, with a cost for the words skipped on either side.
4. The chains of a pair travel as one row a document, with the words that any of them asks (a word in many ranges once). Chained
   ranges are cut out of these, extended at both ends while words keep agreeing (a few words replaced,
   dropped or put in are passed over), and aligned (longest common subsequence of words, bit-parallel). Passages of
   ``MIN_WORDS`` words or more with at least 0.8 of the longer side's words aligned are kept.
5. A phrase that repeats many times in a row matches the same stretch of the other text at each of its places. Passages
   of a pair that overlap in both texts are one run: a row gives the best aligned of them, the words of both texts that
   all of them cover (``run_start`` and so on), and how many they are.

A document of a large class is paired with the class's representatives, not with all others. What can be missed: fuzzy
passages with so many edits that no seed is left whole in both texts, or only seeds whose first document holds no such
passage (tests measure the recall under such noise); a passage ends where more than ``MOST_GAP`` words in a row, or
``REACH`` words beyond the last seed, hold no seed. A passage in ``HOT`` or more places of one slice is paired with
that slice's first document, and that with the first of all: the classes do not depend on slices, these rows do.

Edge cases: null, blank and short texts have no passage; equal rows (id and text) count as one document; equal texts
under two ids are a passage; documents are told apart by id and text, so a repeated id with two texts is two documents;
ties between equal seeds go to the smallest key and place; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import ctypes
import struct
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, materialise, mix, slices

K, WINDOW = 5, 8
PARTNERS = ((13, 28), (33, 44))  # words after a minimizer between which the partner of its near and of its far pair begins
SIZES = np.array([K, *(a + K for a, _ in PARTNERS)])  # words that a seed covers at least, by its kind
HOT = 256  # places in one slice from which on a seed is linked within the slice
SHARD_BYTES = 16 << 20  # bytes of text whose seeds make one shard
KEPT_KEYS = 100_000  # documents with chains up to which their keys are broadcast to leave the other texts out of the shuffle
MIN_WORDS, SIMILARITY = 50, 0.8
GAP_COST, MOST_GAP = 0.1, 64
CROWDED = 1_000  # ranges asked of one document that one task cuts
EDGE = 23  # words of a passage that may lie before its first and after its last shared seed (an exact one has 11 at most): one seed is enough
REACH = 40  # words looked at beyond a chain's ends; more than any seedless stretch of an exact passage
KNOWN = 256  # results of alignments kept for equal ones
BATCH_BYTES = 4 << 20  # bytes of cut words from which on a batch is passed on
BATCH_ROWS = 10_000
GATHER = 8  # slices linked together before the shuffle

BLOBS = "kind int, shard int, blob binary"
CHAINS = "pair long, key long, side int, n int, ranges binary"


def _trim() -> None:
    """Freed memory back to the system: workers stay for later tasks, and hold it beside the executor's heap else."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def minimizers(h: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places in ``h`` that are smallest in some window of one text; a text with fewer than ``window`` hashes is one window."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    low, reach = h.copy(), 1
    while reach < window:
        step = min(reach, window - reach)
        low[: n - step] = np.minimum(low[: n - step], low[step:])
        reach += step
    whole = np.zeros(n, bool)
    whole[: n - window + 1] = owner[: n - window + 1] == owner[window - 1 :] if n >= window else False
    low[~whole] = 0
    high, reach = low, 1
    while reach < window:
        step = min(reach, window - reach)
        high = high.copy()
        high[step:] = np.maximum(high[step:], high[: n - step].copy())
        reach += step
    chosen = (high == h) & (h > 0)
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    size = np.diff(np.append(begin, n))
    least = np.repeat(np.where(size < window, np.minimum.reduceat(h, begin), 0), size)
    return np.flatnonzero(chosen | ((least == h) & (np.repeat(size, size) < window)))


def seeds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every seed: minimizers alone, near pairs, far pairs. A place is the start word times four and the kind (0, 1, 2)."""
    at, h = words.grams(K)
    if not len(at):
        return at, h
    owner = words.text_of()[at]
    pick = minimizers(h, owner)
    last = np.searchsorted(owner, owner[pick], "right") - 1  # of the text's windows
    places, hashes = [at[pick] << 2], [h[pick]]
    low = [h]  # smallest of 1, 2, 4, ... windows from each on
    while 2 << len(low) - 1 <= max(b - a + 1 for a, b in PARTNERS):
        step = 1 << len(low) - 1
        low.append(low[-1].copy())
        np.minimum(low[-2][:-step], low[-2][step:], out=low[-1][:-step])
    for number, (a, b) in enumerate(PARTNERS, 1):
        fits = np.flatnonzero(pick + a <= last)
        one = pick[fits]
        begin, end = one + a, np.minimum(one + b, last[fits])
        level = np.log2(end - begin + 1).astype(np.int64)
        least = np.empty(len(fits), U64)
        for x in range(len(low)):
            use = np.flatnonzero(level == x)
            least[use] = np.minimum(low[x][begin[use]], low[x][end[use] - (1 << x) + 1])
        places.append(at[one] << 2 | number)
        hashes.append(mix(h[one] * U64(0xD6E8FEB86659FD93) + mix(least + U64(number))))
    return np.concatenate(places), np.concatenate(hashes)


def _star(h: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rows of the first documents, matches): of rows with equal ``h`` those of the smallest key, and key and place of the others beside the first's."""
    order = np.lexsort((at, key, h))
    h, key, at = h[order], key[order], at[order]
    begin = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(begin)
    lead = np.repeat(first, np.diff(np.append(first, len(h))))
    own = key == key[lead]
    other, own = np.flatnonzero(~own), np.flatnonzero(own)
    return h[own], key[own], at[own], (key[other], key[lead[other]], at[other], at[lead[other]])


def _repeated(h: np.ndarray, times: int) -> np.ndarray:
    """Places in ``h`` of values that are there ``times`` times or more."""
    if len(h) < times:
        return np.zeros(0, np.int64)
    order = np.argsort(h)
    s = h[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(begin, len(s)))
    return order[np.repeat(size >= times, size)]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or int(x.max()) < 1 << 16 else np.uint32)


def _pack(keys: list[np.ndarray], places: list[np.ndarray], h: np.ndarray | None) -> bytes:
    """Rows of keys (each as a number in the blob's list of keys), places, and hashes, in as few bytes as they need."""
    known, back = np.unique(np.concatenate(keys), return_inverse=True)
    columns = [_narrow(x) for x in (*np.split(back, len(keys)), *places)]
    head = np.array([len(keys[0]), len(known), *(x.itemsize for x in columns)], np.int64)
    return b"".join(x.tobytes() for x in (head, known, *([h] if h is not None else []), *columns))


def _unpack(blob: bytes, n_keys: int, n_places: int, hashed: bool) -> list[np.ndarray]:
    """Keys, places, and then hashes as packed."""
    n, n_known, *sizes = np.frombuffer(blob, np.int64, 2 + n_keys + n_places).tolist()
    at = 8 * (2 + len(sizes))
    known = np.frombuffer(blob, np.int64, n_known, at)
    at += 8 * n_known
    h = np.frombuffer(blob, U64, n if hashed else 0, at)
    at += h.nbytes
    columns = []
    for size in sizes:
        columns.append(np.frombuffer(blob, np.uint16 if size == 2 else np.uint32, n, at))
        at += n * size
    return [*(known[x] for x in columns[:n_keys]), *(x.astype(np.int64) for x in columns[n_keys:]), *([h] if hashed else [])]


def _deal(kind: int, shard: np.ndarray, keys: list[np.ndarray], places: list[np.ndarray], h: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows, one a shard."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    shard, keys, places, h = shard[order], [x[order] for x in keys], [x[order] for x in places], h if h is None else h[order]
    begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    ends = np.append(begin[1:], len(shard))
    blobs = [_pack([x[a:b] for x in keys], [x[a:b] for x in places], h if h is None else h[a:b]) for a, b in zip(begin, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), kind, np.int32)), pa.array(shard[begin].astype(np.int32)), pa.array(blobs, pa.binary())], ["kind", "shard", "blob"])


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return (mix(x.view(U64)) % U64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)


def _matches(found: tuple[np.ndarray, ...], shards: int) -> Iterator[pa.RecordBatch]:
    yield from _deal(1, _shard(found[0], shards), list(found[:2]), list(found[2:]))


def _spread(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def emit():
            h, key, at = (np.concatenate([x[i] for x in held]) for i in range(3))
            held.clear()
            hot = _repeated(h, HOT)
            if len(hot):
                rest = np.ones(len(h), bool)
                rest[hot] = False
                *own, found = _star(h[hot], key[hot], at[hot])
                yield from _matches(found, shards)
                h, key, at = (np.concatenate([x[rest], y]) for x, y in zip((h, key, at), own, strict=True))
            yield from _deal(0, _shard(h, shards), [key], [at], h)

        for rows, data, offsets in slices(batches):
            words = Words(data, offsets, lower=True)
            at, h = seeds(words)
            owner = words.text_of()[at >> 2] if len(at) else at
            key = rows.column(0).to_numpy(zero_copy_only=False)
            held.append((h, key[owner], at - (words.first[owner] << 2)))
            if len(held) >= GATHER:
                yield from emit()
        if held:
            yield from emit()
        _trim()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each shard; rows come sorted by shard."""
    current, blobs = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if shard != current and blobs:
                yield current, blobs
                blobs = []
            current = shard
            blobs.append(blob)
    if blobs:
        yield current, blobs


def _link(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own():
            for batch in batches:
                kind = batch.column(0).to_numpy(zero_copy_only=False)
                passed.append(batch.take(pa.array(np.flatnonzero(kind == 1))))
                yield batch.take(pa.array(np.flatnonzero(kind == 0)))

        passed: list = []
        for _, blobs in _groups(own()):
            yield from passed
            passed.clear()
            key, at, h = (np.concatenate(x) for x in zip(*(_unpack(b, 1, 1, True) for b in blobs), strict=True))
            shared = _repeated(h, 2)
            *_, found = _star(h[shared], key[shared], at[shared])
            yield from _matches(found, shards)
        yield from passed
        _trim()

    return run


class Fenwick:
    """Prefix maxima over places 0 .. n - 1, with the item that has the maximum."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, item: int) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place][0]:
                self.best[place] = (value, item)
            place += place & -place

    def before(self, place: int) -> tuple[float, int]:
        """The best of places below ``place``."""
        out = (float("-inf"), -1)
        while place > 0:
            if self.best[place][0] > out[0]:
                out = self.best[place]
            place -= place & -place
        return out


def chain(a: list[int], b: list[int], size: list[int], gap_cost: float = GAP_COST, most_gap: int = MOST_GAP) -> list[list[int]]:
    """Collinear chains of matches (places ``a`` ascending, ``b``, lengths), best first, each match in one chain at most.

    Each match adds ``K`` to a chain's score and each word from its predecessor's place to its own, in either text, takes
    ``gap_cost``. Matches at the same place of ``a`` are not chained with each other. Chains are cut at gaps above
    ``most_gap`` words in either text.
    """
    places = sorted(set(b))
    tree = Fenwick(len(places))
    score, back = [0.0] * len(a), [-1] * len(a)
    waiting: list[int] = []
    for j in range(len(a)):
        if waiting and a[waiting[-1]] != a[j]:
            for i in waiting:
                tree.put(bisect_left(places, b[i]), score[i] + gap_cost * (a[i] + b[i]), i)
            waiting = []
        value, i = tree.before(bisect_left(places, b[j]))
        gain = value - gap_cost * (a[j] + b[j])
        score[j], back[j] = (K + gain, i) if gain > 0 else (float(K), -1)
        waiting.append(j)
    used, out = [False] * len(a), []
    for j in sorted(range(len(a)), key=lambda x: -score[x]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        path.reverse()
        piece: list[int] = []
        for j in path:
            if piece and (a[j] - a[piece[-1]] - size[piece[-1]] > most_gap or b[j] - b[piece[-1]] - size[piece[-1]] > most_gap):
                out.append(piece)
                piece = []
            piece.append(j)
        if piece:
            out.append(piece)
    return out


def _chains(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in _groups(batches):
            m = np.stack([np.concatenate(x) for x in zip(*(_unpack(b, 2, 2, False) for b in blobs), strict=True)])
            kind, m[2:] = m[2] & 3, m[2:] >> 2
            order = np.lexsort((-kind, m[3], m[2], m[1], m[0]))
            m, size = m[:, order], SIZES[kind[order]]
            new = np.concatenate([[True], (m[:, 1:] != m[:, :-1]).any(0)])  # all seeds of a minimizer may match: the widest counts
            m, size = m[:, new], size[new]
            begin = np.flatnonzero(np.concatenate([[True], (m[0, 1:] != m[0, :-1]) | (m[1, 1:] != m[1, :-1])]))
            ends = np.append(begin[1:], m.shape[1])
            span = np.maximum.reduceat(m[2] + size, begin) - m[2, begin]
            number, rows = 0, []
            for g in np.flatnonzero(span + 2 * EDGE >= least):
                lo, hi = int(begin[g]), int(ends[g])
                a, b, s = m[2, lo:hi].tolist(), m[3, lo:hi].tolist(), size[lo:hi].tolist()
                ranges: tuple[list, list] = [], []
                for piece in chain(a, b, s):
                    i = piece[0]
                    a1, b1 = max(a[x] + s[x] for x in piece), max(b[x] + s[x] for x in piece)
                    if min(a1 - a[i], b1 - b[i]) + 2 * EDGE < least:
                        continue
                    for side, p, q in ((0, a[i], a1), (1, b[i], b1)):
                        low = max(0, p - REACH)
                        ranges[side].extend((low, q + REACH, p - low, q - low))
                if not ranges[0]:
                    continue
                for side in (0, 1):
                    rows.append(((shard << 40) | number, int(m[side, lo]), side, len(ranges[side]) // 4, np.array(ranges[side], np.int32).tobytes()))
                number += 1
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows, _CHAINS)
                    rows = []
            if rows:
                yield _batch(rows, _CHAINS)
        _trim()

    return run


CUT = "pair long, side int, doc_id long, ranges binary, words binary"


def _schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in columns.split(", ")])


_CHAINS, _CUT = _schema(CHAINS), _schema(CUT)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _asked(ranges: bytes, n: int) -> tuple[bytes, list[tuple[int, int]]]:
    """Of ranges (low, high, chain's start and end in it) of a text of ``n`` words: the stretches that they cover, and the ranges as (place in
    the joined stretches, size, low, start, end)."""
    if len(ranges) == 16:
        low, high, left, right = struct.unpack("=4i", ranges)
        high = min(high, n)
        return struct.pack("=5i", 0, high - low, low, left, right), [(low, high)]
    low, high, left, right = np.frombuffer(ranges, np.int32).reshape(-1, 4).T
    high = np.minimum(high, n)
    order = np.argsort(low, kind="stable")
    begin, end = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    begin, end = begin[new], end[np.append(new[1:], len(low)) - 1]
    before = begin - (np.cumsum(end - begin) - (end - begin))  # words left out before each stretch
    at = low - before[np.searchsorted(begin, low, "right") - 1]
    return np.stack([at, high - low, low, left, right], 1).astype(np.int32).tobytes(), list(zip(begin.tolist(), end.tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's row comes before the ranges asked of it, so it is split once and then let go."""
    doc, words = None, []
    for batch in batches:
        kinds, pairs, sides, docs, ranges, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("kind", "pair", "side", "doc_id", "ranges", "text"))
        rows, size = [], 0
        for i, (kind, pair, side) in enumerate(zip(kinds.to_pylist(), pairs.to_pylist(), sides.to_pylist(), strict=True)):
            if kind == 0:
                doc, words = docs[i].as_py(), (texts[i].as_py() or "").encode().lower().split()
                continue
            places, stretches = _asked(ranges[i].as_py(), len(words))
            cut = b" ".join([b" ".join(words[low:high]) for low, high in stretches])
            rows.append((pair, side, doc, places, cut))
            size += len(places) + len(cut)
            if size >= BATCH_BYTES:
                yield _batch(rows, _CUT)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _CUT)
    _trim()


def common_length(a: list, b: list) -> int:
    """Length of a longest common subsequence (bit-parallel, one long integer)."""
    if a == b:
        return len(a)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    v = mask
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def _extend(a: list, b: list, i: int, j: int, step: int, drop: int = 6) -> tuple[int, int]:
    """Words beyond a[i] and b[j] in one direction up to the best-scoring end.

    An equal word gives 1. Where words differ, the fewest words (``JUMP`` at most a side) are passed over on both sides
    after which two agree again, for 1 each; if there is no such place, one word on either side.
    """
    score = best = reach_a = reach_b = 0
    x, y = 0, 0  # words done on each side
    most_a, most_b = (i + 1, j + 1) if step < 0 else (len(a) - i, len(b) - j)
    while x < most_a and y < most_b and score > best - drop:
        if a[i + step * x] == b[j + step * y]:
            x, y, score = x + 1, y + 1, score + 1
            if score > best:
                best, reach_a, reach_b = score, x, y
            continue
        for p, q in _JUMPS:
            if x + p + 1 < most_a and y + q + 1 < most_b and a[i + step * (x + p)] == b[j + step * (y + q)] and a[i + step * (x + p + 1)] == b[j + step * (y + q + 1)]:
                break
        else:
            p = q = 1
        x, y, score = x + p, y + q, score - max(p, q)
    return reach_a, reach_b


JUMP = 2
_JUMPS = sorted(((p, q) for p in range(JUMP + 1) for q in range(JUMP + 1) if p or q), key=lambda x: (max(x), sum(x), x))


PASSAGES = "doc_id long, start_word int, end_word int, other_doc_id long, other_start int, other_end int, equal_words int, similarity double"
RUNS = f"{PASSAGES}, run_start int, run_end int, other_run_start int, other_run_end int, n_passages int"
_RUNS = _schema(RUNS)


def _aligned(one: tuple, two: tuple, least: int, similarity: float) -> tuple[int, int, int, int, int] | None:
    """Of two cuts (words, chain's start and end in them): start and end in each, equal words; None if they are no passage."""
    a, b = one[0], two[0]
    back, back_b = _extend(a, b, one[1] - 1, two[1] - 1, -1)
    on, on_b = _extend(a, b, one[2], two[2], 1)
    a0, a1, b0, b1 = one[1] - back, one[2] + on, two[1] - back_b, two[2] + on_b
    x, y = a[a0:a1], b[b0:b1]
    if min(len(x), len(y)) < least:
        return None
    n = common_length(x, y)
    return (a0, a0 + len(x), b0, b0 + len(y), n) if n >= similarity * max(len(x), len(y)) else None


def _pair(one: tuple, two: tuple, least: int, similarity: float) -> list[tuple]:
    """Passages of two documents (id, ranges, words), chain by chain."""
    places, places_2 = (list(struct.iter_unpack("=5i", x[1])) for x in (one, two))
    a, b = one[2].split(b" "), two[2].split(b" ")
    if many := len(places) > 1:  # words as numbers: the bytes of a range tell whether it was seen
        number: dict = {}
        a, b = ([number.setdefault(w, len(number)) for w in x] for x in (a, b))
        coded, coded_2 = (np.array(x, np.int32).tobytes() for x in (a, b))
    known: dict = {}
    out = []
    for (at, size, low, left, right), (at_2, size_2, low_2, left_2, right_2) in zip(places, places_2, strict=True):
        key = (coded[4 * at : 4 * (at + size)], left, right, coded_2[4 * at_2 : 4 * (at_2 + size_2)], left_2, right_2) if many else None
        found = known.get(key, 0)
        if found == 0:
            if len(known) >= KNOWN:
                known.clear()
            found = known[key] = _aligned((a[at : at + size], left, right), (b[at_2 : at_2 + size_2], left_2, right_2), least, similarity)
        if found:
            a0, a1, b0, b1, n = found
            out.append((one[0], low + a0, low + a1, two[0], low_2 + b0, low_2 + b1, n, n / max(a1 - a0, b1 - b0)))
    return out


def _runs(found: list[tuple]) -> list[tuple]:
    """Passages of one pair; those that overlap in both texts become one row."""
    done, open_runs = [], []  # best passage, its rank, run in one text, run in the other, number of passages
    for p in sorted(found, key=lambda x: (x[1], x[4], x[2], x[5])):
        _, start, end, _, start_2, end_2, equal, alike = p
        run = (p, (equal, alike, -start, -start_2), start, end, start_2, end_2, 1)
        still = []
        for r in open_runs:
            if r[3] <= start:
                done.append(r)
            elif r[4] < end_2 and start_2 < r[5]:
                best = run if run[1] > r[1] else r
                run = (*best[:2], min(r[2], run[2]), max(r[3], run[3]), min(r[4], run[4]), max(r[5], run[5]), r[6] + run[6])
            else:
                still.append(r)
        open_runs = [*still, run]
    return [(*r[0], *r[2:]) for r in (*done, *open_runs)]


def _align(least: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple = ()
        for batch in batches:
            out: list[tuple] = []
            sides, docs, ranges, words = (batch.column(batch.schema.get_field_index(c)) for c in ("side", "doc_id", "ranges", "words"))
            for i, (side, doc) in enumerate(zip(sides.to_pylist(), docs.to_pylist(), strict=True)):
                row = (doc, ranges[i].as_py(), words[i].as_py())
                if side == 0:
                    first = row
                elif found := _pair(first, row, least, similarity):
                    out += _runs(found)
            if out:
                yield _batch(out, _RUNS)
        _trim()

    return run


def passages(docs: DataFrame, least: int = MIN_WORDS, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of ``doc_id`` that ``other_doc_id`` holds as well: word ranges in both, equal words, similarity, and the run of overlapping ones."""
    if least < WINDOW + K + PARTNERS[0][1]:
        raise ValueError("passages must be longer than the stretch in which a shared pair is certain")
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))  # a task holds one of its shards at a time
    dealt = plain.select("key", "text").mapInArrow(_spread(shards), BLOBS)
    linked = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_link(shards), BLOBS)
    chains = materialise(linked.repartition("shard").sortWithinPartitions("shard").mapInArrow(_chains(least), CHAINS), "chains")
    load = chains.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("pairs")).where(F.col("n") > CROWDED)
    crowded = materialise(load.select("key", F.least(F.ceil(F.col("n") / CROWDED), "pairs").cast("int").alias("parts")), "crowded")
    asked_keys = materialise(chains.select("key").distinct(), "asked")
    if asked_keys.count() <= KEPT_KEYS:  # checked: so few rows; beyond that all texts take part in the shuffle
        plain = plain.join(F.broadcast(asked_keys), "key", "left_semi")
    bodies = plain.select("key", F.lit(0).alias("kind"), "doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CHAINS.split(", ") if x.split()[0] != "key")])
    asked = chains.select("key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *[x.split()[0] for x in CHAINS.split(", ") if x.split()[0] != "key"])
    if crowded.isEmpty():
        bodies, asked = bodies.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    else:  # the ranges asked of a crowded document are split over several copies of it
        parts = F.coalesce("parts", F.lit(1))
        bodies = bodies.join(crowded, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        asked = asked.join(crowded, "key", "left").withColumn("part", F.pmod(F.xxhash64("pair"), parts).cast("int")).drop("parts")
    met = bodies.unionByName(asked).repartition("key", "part").sortWithinPartitions("key", "part", "kind", "pair")
    cut = met.select("kind", "doc_id", "text", "pair", "side", "ranges").mapInArrow(_cut, CUT)
    return cut.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(_align(least, similarity), RUNS)

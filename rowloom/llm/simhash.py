"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. It is cut into projections so that two fingerprints within the distance differ in at most
``t`` bits of one projection (pigeonhole). On each projection the anchors are a covering code: the Hamming code of
2^r - 1 bits beside free bits, of covering radius 1. A fingerprint's home is the anchor within radius 1; it visits
every anchor within radius 1 + t, and so meets the home of any partner. Per anchor visitors are compared with homes.

Three projections of 21 or 22 bits (t = 1) make about 44 copies a fingerprint over 2^17 anchors each; from
``WIDE_FROM`` distinct fingerprints on, two of 32 bits (t = 2) make about 340 copies over 2^27 anchors, so that groups
stay small. Both find exactly the same links.

Edge cases: null or blank texts have fingerprint zero and link like any other; equal rows share one fingerprint;
a null doc_id takes part but never names a component unless all its members are null; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bits_per_text, materialise, slices, xxh64
from .graph import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
WIDE_FROM = 1 << 26
HOMES = 4096  # homes that one task holds at a time; an anchor with more is split over several
PAIRS = 1 << 20


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = Words(data, offsets, lower=True, hashes=False)
    joined, start, end = words.joined()
    n = words.count
    windows = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    which = np.repeat(np.arange(len(n)), windows)
    first = words.first[:-1][which] + np.arange(len(which)) - (np.cumsum(windows) - windows)[which]
    last = first + np.minimum(n[which], shingle) - 1
    h = xxh64(joined, start[first], end[last] - start[first], seed) if len(first) else np.zeros(0, U64)
    ones = bits_per_text(h, windows)
    return np.packbits(2 * ones > windows[:, None], axis=1, bitorder="little").view("<u8").ravel()


def add_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the fingerprint as a signed long."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep if c != text], F.col(f"`{text}`"))
    schema = source.select(*[F.col(f"`{c}`") for c in keep]).withColumn(name, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, text):
            fp = fingerprints_of(data, offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in keep], pa.array(fp)], [*keep, name])

    return source.mapInArrow(run, schema)


class Cover:
    """One projection: ``width`` bits from bit ``low`` on; Hamming code of 2^r - 1 bits and free bits above it."""

    def __init__(self, number: int, low: int, width: int, r: int, threshold: int):
        self.number, self.low, self.width, self.r = number, low, width, r
        n = (1 << r) - 1
        self.n, radius = n, 1 + threshold
        self.masks: list[np.ndarray] = []
        by_syndrome: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for w in range(radius + 1):
            for bits in combinations(range(n), w):
                s = 0
                for b in bits:
                    s ^= b + 1
                by_syndrome[s].append((w, sum(1 << b for b in bits)))
        free = [(w, sum(1 << (n + b) for b in bits)) for w in range(radius + 1) for bits in combinations(range(width - n), w)]
        for s in range(n + 1):
            self.masks.append(np.array([m | f for w, m in by_syndrome[s] for v, f in free if w + v <= radius], U64))
        self.correct = np.array([0, *(1 << b for b in range(n))], U64)  # the bit to flip for each syndrome

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, home?) for every anchor within the radius."""
        x = (fp >> U64(self.low)) & U64((1 << self.width) - 1)
        syndrome = np.zeros(len(fp), np.int64)
        for b in range(self.n):
            syndrome ^= np.where((x >> U64(b)) & U64(1), b + 1, 0)
        rows, out, home = [], [], []
        for s in np.unique(syndrome):
            i = np.flatnonzero(syndrome == s)
            a = x[i][:, None] ^ self.masks[s][None, :]
            rows.append(np.repeat(i, a.shape[1]))
            out.append(a.ravel() | U64(self.number << 60))
            home.append((a == (x[i] ^ self.correct[s])[:, None]).ravel())
        return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in (rows, out, home))


def covers(wide: bool) -> list[Cover]:
    if wide:
        return [Cover(i, 32 * i, 32, 5, 2) for i in range(2)]
    return [Cover(0, 0, 21, 4, 1), Cover(1, 21, 21, 4, 1), Cover(2, 42, 22, 4, 1)]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``a[i]`` and ``b[i]``; ``label`` holds the smallest row of each class."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label[:] = next_


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group (anchor, part), homes first. Gives links that connect what is linked within a group."""
    held: tuple[np.ndarray, np.ndarray] | None = None  # the last group's homes
    for batch in batches:
        key = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
        home = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        fp = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
        if held is not None and key.shape[1]:
            k, f = held
            key = np.concatenate([np.repeat(k[:, None], len(f), 1), key], 1)
            home, fp = np.concatenate([np.ones(len(f), bool), home]), np.concatenate([f, fp])
        if not len(fp):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        size = np.diff(np.append(begin, len(fp)))
        homes = np.add.reduceat(home.astype(np.int64), begin)
        held = (key[:, begin[-1]], fp[begin[-1] : begin[-1] + homes[-1]])
        pairs = np.repeat(homes, size)
        from_ = np.repeat(begin, size)
        label, done = np.arange(len(fp)), 0
        total = np.cumsum(pairs)
        while done < len(fp):
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
            n = pairs[done:to]
            row = np.repeat(np.arange(done, to), n)
            other = from_[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            near = (np.bitwise_count(fp[row] ^ fp[other]) <= distance) & (row != other)
            if near.any():
                _merge(label, row[near], other[near])
            done = to
        linked = np.flatnonzero(label != np.arange(len(fp)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], ["a", "b"])


def links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (``a``, ``b``) that connect exactly what chains of pairs within ``distance`` connect; ``fp`` is distinct.

    Within an anchor linked fingerprints are named by one of them, so a dense group gives a row a member, not all pairs.
    """
    if distance > 4:
        raise ValueError("the projections cover distances up to 4")
    wide = fingerprints.count() >= WIDE_FROM

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = covers(wide)
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            for at in range(0, len(whole), 1000):
                fp = whole[at : at + 1000]
                for cover in plan:
                    rows, anchor, home = cover.anchors(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[rows].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    copies = fingerprints.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    crowded = materialise(copies.where("home").groupBy("anchor").count().where(F.col("count") > HOMES).select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("parts")), "crowded")
    if crowded.isEmpty():
        dealt = copies.withColumn("part", F.lit(0))
    else:  # homes of a crowded anchor are split, its visitors meet each part
        parts = F.coalesce("parts", F.lit(1))
        split = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("fp"), parts).cast("int"))).otherwise(F.array())
        visits = F.explode(F.sequence(F.lit(0), parts - 1))
        joined = copies.join(crowded, "anchor", "left").withColumn("own", split).withColumn("part", visits)
        dealt = joined.withColumn("home", F.array_contains("own", F.col("part"))).select("anchor", "fp", "home", "part")
    groups = dealt.select("anchor", "part", "home", "fp").repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.col("home").desc())
    return groups.mapInArrow(lambda b: _compare(b, distance), "a long, b long").distinct()


def classes(fingerprints: DataFrame) -> DataFrame:
    """``fp`` and ``root`` for every distinct fingerprint of a materialised table with a column ``fp``."""
    distinct = materialise(fingerprints.select("fp").distinct(), "distinct-fp")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable)."""
    table = materialise(add_fingerprint(docs, [doc_id], text).select(F.col(f"`{doc_id}`").alias("doc_id"), "fp"), "fingerprints")
    root = materialise(classes(table), "classes")
    lowest = materialise(table.groupBy("fp").agg(F.min("doc_id").alias("low")), "lowest")
    roots = materialise(lowest.join(root, "fp").groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    named = materialise(root.join(roots, "root").select("fp", "component_id"), "named")  # written, so that the next join can split a hot fingerprint
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id (nulls last, then the first row met)."""
    columns = docs.columns
    marked = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at, body = f"c{columns.index(doc_id)}", f"c{columns.index(text)}"
    table = materialise(add_fingerprint(marked, marked.columns, body).withColumn("row", F.monotonically_increasing_id()), "marked")
    root = classes(table)
    best = F.min(F.struct(F.col(at).isNull().alias("n"), F.col(at).alias("d"), F.col("row").alias("r")))
    low = table.groupBy("fp").agg(best.alias("best")).join(root, "fp")
    kept = low.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.r").alias("row"))
    return table.join(kept, "row", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])

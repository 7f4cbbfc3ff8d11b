"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

1. An item of n words may be edited in e = n / 5 places (rounded down; a word replaced, dropped or put in), as at least 0.8
   of its words must be found. Then (n - e) / (e + 1) words in a row, rounded up, stay whole: that, four at most, is the
   length k of the item's seeds: four for 16 words or more, the whole item for four words or fewer.
2. All k-word grams of the items go into bit maps (one bit a hash), one for each k and class of item lengths. A map's size
   follows the number of its grams up to 2^28 bits, so that 32 MB at most a map are broadcast; beyond, it only lets more
   false hits through to the join. One pass over the texts keeps, around the grams whose bit is set, the passage that an
   item of that class could cover.
3. Hits are counted over the corpus. Of an item's N = n - k + 1 grams at least t = max(1, N - e k) outlive e edits, so its
   N - t + 1 rarest are the seeds: one of them is in every copy with e edits or fewer, wherever these are.
4. Seeds join passages to items by hash; each candidate pair is aligned word by word. A pair is a leak if the words
   aligned as equal are at least 0.8 of the item's words. (More than e edits can still align so, if words are put in as
   well; such copies are found as long as one seed is left.)

Words are lower-cased (Unicode) runs without ASCII punctuation. Edge cases: null or blank texts and items match
nothing; items of any length are sought, of fewer than five words only whole; equal items each match; equal rows with one
doc_id give one row; an empty table on either side gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import smith_waterman
from .common import U64, Words, materialise, slices

MOST_SEED_WORDS, SIMILARITY = 4, 0.8
MAP_BITS = (20, 28)
BROADCAST_SEEDS, BROADCAST_LEAKS = 1_000_000, 200_000
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32

GRAMS = "item long, n int, k int, edits int, class int, at int, h long"
PASSAGES = "doc_id long, mark string, start int, words string, hits array<struct<h:long,at:int>>"


def plain_slices(batches: Iterator[pa.RecordBatch], column: str):
    """Slices with lower-case text, and their words."""

    def lowered():
        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, column, pc.utf8_lower(b.column(i)))

    for rows, data, offsets in slices(lowered(), column):
        yield rows, Words(_PLAIN[data], offsets)


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return materialise(benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")


def seed_length(n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Words in a seed, and edits, of items of ``n`` words."""
    edits = np.floor(n * (1 - similarity) + 1e-9).astype(np.int64)
    return np.clip(-(-(n - edits) // (edits + 1)), 1, MOST_SEED_WORDS), edits


def slack(n):
    """Words beside an item's place that its alignment may use."""
    return 4 + n // 4


def _grams(items: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in plain_slices(batches, "text"):
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            length, edits = seed_length(words.count, similarity)
            size_class = np.ceil(np.log2(np.maximum(words.count, 1)) / 2).astype(np.int64)  # powers of four
            for k in range(1, MOST_SEED_WORDS + 1):
                at, h = words.grams(k)
                owner = words.text_of()[at]
                use = length[owner] == k
                at, h, owner = at[use], h[use], owner[use]
                numbers = [words.count[owner], np.full(len(at), k), edits[owner], size_class[owner], at - words.first[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array(h.view(np.int64))], ["item", "n", "k", "edits", "class", "at", "h"])

    return items.select("item", "text").mapInArrow(run, GRAMS)


def _bit_maps(grams: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(k, margin of words, bit map) of each seed length and class of item lengths."""
    out = []
    for r in grams.groupBy("k", "class").agg(F.countDistinct("h").alias("grams"), F.max("n").alias("n")).collect():  # a few
        bits = min(max(MAP_BITS[0], int(np.ceil(np.log2(max(r["grams"], 1) * 64)))), MAP_BITS[1])
        place = F.pmod("h", F.lit(1 << bits)) + 1
        some = grams.where((F.col("k") == r["k"]) & (F.col("class") == r["class"]))
        rows = some.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
        bit_map = np.zeros(1 << (bits - 3), np.uint8)
        for x in rows:
            bit_map[(x["b"] - 1) * 4096 : x["b"] * 4096] = np.frombuffer(bytes(x["m"]), np.uint8)
        out.append((r["k"], r["n"] + slack(r["n"]), bit_map))
    return out


def _hits(words: Words, maps: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """First word, hash, and the range of words to keep around it, of each gram that is in a map; by first word."""
    found = []
    owner = words.text_of()
    for k in sorted({k for k, _, _ in maps}):
        at, h = words.grams(k)
        margin = np.full(len(at), -1, np.int64)
        for _, wide, bit_map in (m for m in maps if m[0] == k):
            bit = h & U64(len(bit_map) * 8 - 1)
            hit = (bit_map[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1
            np.maximum(margin, np.where(hit, wide, -1), out=margin)
        hit = np.flatnonzero(margin >= 0)
        at, margin, d = at[hit], margin[hit], owner[at[hit]]
        found.append((at, h[hit].view(np.int64), np.maximum(words.first[d], at - margin), np.minimum(words.first[d + 1], at + k + margin)))
    at, h, low, high = (np.concatenate([f[i] for f in found]) for i in range(4))
    order = np.argsort(at, kind="stable")
    return at[order], h[order], low[order], high[order]


def _passages(docs: DataFrame, maps: list[tuple[int, int, np.ndarray]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in plain_slices(batches, "text"):
            at, h, low, high = _hits(words, shared.value)
            if not len(at):
                continue
            by_low = np.argsort(low, kind="stable")
            reach = np.maximum.accumulate(high[by_low])
            new = np.concatenate([[True], low[by_low][1:] >= reach[:-1]])  # ranges that overlap are one passage
            first = np.flatnonzero(new)
            begin, end = low[by_low][first], reach[np.append(first[1:], len(new)) - 1]
            passage = np.searchsorted(begin, at, "right") - 1
            owner = np.searchsorted(words.first, begin, "right") - 1
            texts = [b" ".join(words.data[words.start[a] : words.end[b - 1]].tobytes().split()) for a, b in zip(begin, end, strict=True)]
            bounds = np.searchsorted(passage, np.arange(len(begin) + 1))
            hits = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(h), pa.array((at - begin[passage]).astype(np.int32))], ["h", "at"]))
            picked = rows.take(pa.array(owner))
            columns = [picked.column(0), picked.column(2), pa.array((begin - words.first[owner]).astype(np.int32)), pa.array(texts, pa.binary()).cast(pa.string()), hits]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "start", "words", "hits"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, PASSAGES)


def _hashes(texts: pa.Array) -> list[np.ndarray]:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    out = []
    for _, words in plain_slices(iter([batch]), "text"):
        out += np.split(words.hash, words.first[1:-1])
    return out


def _aligned(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                get = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: B023, E731
                items, passages = _hashes(get("item_text")), _hashes(get("words"))
                low, high = (get(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
                cut, shift = [], []
                for item, passage, lo, hi in zip(items, passages, low, high, strict=True):
                    first = max(0, int(lo) - slack(len(item)))
                    shift.append(first)
                    cut.append((item, passage[first : int(hi) + len(item) + slack(len(item))]))
                found = smith_waterman(cut)
                share = found[:, 1] / np.array([max(len(i), 1) for i in items])
                ok = np.flatnonzero(share >= similarity)
                base = get("start").to_numpy(zero_copy_only=False) + np.array(shift)
                columns = [get("doc_id"), get("mark"), get("item_id"), pa.array((base + found[:, 2]).astype(np.int64)), pa.array((base + found[:, 3]).astype(np.int64)), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "item_id", "start_word", "end_word", "score", "equal_words", "similarity"]).take(pa.array(ok))

    return pairs.mapInArrow(run, LEAKS)


LEAKS = "doc_id long, mark string, item_id long, start_word long, end_word long, score long, equal_words long, similarity double"


def _leaks(plain: DataFrame, benchmark: DataFrame, similarity: float, item_id: str, item_text: str) -> DataFrame:
    """``plain``: doc_id, text, mark. Aligned pairs with the mark."""
    spark = plain.sparkSession
    items = _items(benchmark, item_id, item_text)
    grams = materialise(_grams(items, similarity), "grams")
    maps = _bit_maps(grams)
    if not maps:
        return spark.createDataFrame([], LEAKS)
    passages = materialise(_passages(plain, maps).withColumn("passage", F.monotonically_increasing_id()), "passages")
    hits = passages.select("passage", F.explode("hits").alias("x")).select("passage", "x.h", F.col("x.at").alias("in_passage"))
    counts = hits.groupBy("h").agg(F.count("*").alias("c"))
    every = F.col("n") - F.col("k") + 1
    spared = F.greatest(F.lit(1), every - F.col("edits") * F.col("k")) - 1  # of the most frequent grams
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("c", F.lit(0)), "at"))
    seeds = grams.join(counts, "h", "left").withColumn("rank", rank).where((F.col("rank") <= every - spared) & F.col("c").isNotNull())
    seeds = materialise(seeds.select("item", "at", "h"), "seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)  # checked: so few rows; beyond that the join shuffles and splits hot hashes
    shift = F.col("in_passage") - F.col("at")
    pairs = hits.join(seeds, "h").groupBy("passage", "item").agg(F.min(shift).alias("low"), F.max(shift).alias("high"))
    full = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").join(passages.select("passage", "doc_id", "mark", "start", "words"), "passage")
    return _aligned(full, similarity)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Aligned pairs: doc_id, item_id, the words' range in the document, score, equal words, similarity."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.lit(None).cast("string").alias("mark"))
    return _leaks(plain, benchmark, similarity, item_id, item_text).drop("mark")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The best alignment of each document and item that reaches the similarity."""
    best = F.max_by(F.struct("start_word", "end_word", "score", "equal_words", "similarity"), F.struct("equal_words", "score", -F.col("start_word"))).alias("b")
    return leaks(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those whose text holds a test item. Rows are matched by the text's SHA-256, so null or repeated ids do no harm."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    body = F.col(f"c{columns.index(text)}")
    source = plain.select(F.lit(None).cast("long").alias("doc_id"), body.alias("text"), F.sha2(body, 256).alias("mark"))
    found = materialise(_leaks(source, benchmark, similarity, item_id, item_text).select("mark").distinct(), "leaking")
    if found.count() <= BROADCAST_LEAKS:
        found = F.broadcast(found)  # checked: so few rows; the texts need no shuffle then
    return plain.withColumn("mark", F.sha2(body, 256)).join(found, "mark", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])

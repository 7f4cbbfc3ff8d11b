"""Token ids and their binary format: fixed-size id blocks, split into byte or bit planes, each compressed by zstandard.

A *chunk* is one row of the token table and one blob: it holds whole documents only, so chunks decode independently.
Blob layout (little endian):

    8 bytes   magic ``RLPLANE1``
    u64       number of ids
    u32       ids in a block
    u8        planes of a block: 4 (byte planes) or 32 (bit planes)
    u32[]     the chunk index: compressed size of every plane, block by block
    bytes     the planes in that order; a plane has one bit or byte for each id of its block

The table's other columns index the chunks: ``part`` and ``chunk`` (their order), ``first`` (ids before it in the
part), ``n_ids``, and ``docs`` (doc_id, offset in the chunk, n_tokens). Parts ascend in doc_id (nulls first; equal
ids are ordered by a hash of the text), or keep the order of the rows as they come (``order="given"``, for shuffled
ones: nothing is sorted or moved). Written through Spark's own commit protocol, a retried task leaves no trace.

Edge cases: null or empty texts have the end id only; an empty table gives an empty token table; extra columns go unread.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

MAGIC = b"RLPLANE1"
BLOCK = 1 << 16
CHUNK_IDS = 1 << 19
END_ID = 0
CHUNK_SCHEMA = "part int, chunk int, first long, n_ids long, docs array<struct<doc_id:long,offset:long,n_tokens:long>>, blob binary"


# ---- planes

def pack_planes(ids: np.ndarray, block: int = BLOCK, planes: str = "byte", level: int = 3) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    n_planes = {"byte": 4, "bit": 32}[planes]
    press = zstandard.ZstdCompressor(level=level)
    out = []
    for at in range(0, len(ids), block):
        raw = ids[at : at + block].view(np.uint8).reshape(-1, 4)
        if planes == "byte":
            rows = raw.T
        else:
            rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
        out += [press.compress(np.ascontiguousarray(r).tobytes()) for r in rows]
    head = MAGIC + struct.pack("<QIB", len(ids), block, n_planes) + np.array([len(x) for x in out], "<u4").tobytes()
    return head + b"".join(out)


def unpack_planes(blob: bytes) -> np.ndarray:
    if blob[:8] != MAGIC:
        raise ValueError("not a token chunk")
    n, block, n_planes = struct.unpack_from("<QIB", blob, 8)
    blocks = -(-n // block)
    sizes = np.frombuffer(blob, "<u4", blocks * n_planes, 21)
    at = 21 + 4 * len(sizes)
    press = zstandard.ZstdDecompressor()
    ids = np.empty(n, "<u4")
    for b in range(blocks):
        m = min(block, n - b * block)
        rows = []
        for s in sizes[b * n_planes : (b + 1) * n_planes]:
            rows.append(np.frombuffer(press.decompress(blob[at : at + s], max_output_size=max(m, 1)), np.uint8))
            at += int(s)
        if n_planes == 4:
            raw = np.stack(rows, 1)
        else:
            bits = np.stack([np.unpackbits(r, bitorder="little")[:m] for r in rows], 1)
            raw = np.packbits(bits, axis=1, bitorder="little")
        ids[b * block : b * block + m] = np.ascontiguousarray(raw).view("<u4").ravel()
    return ids


# ---- ids

# The pre-tokenizer's pattern over the characters that PLAIN lets pass: there, LETTER and NUMBER are all of Unicode's L and N.
PLAIN = "\\t\\n\\r -~¡-¬®-ɏ‐-‧"
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+(?!\\S)|\\s+").findall
UNUSUAL = re.compile(f"[^{PLAIN}]").search


class _Memo(dict):
    """Ids of pieces, filled on demand; ``old`` is the generation before."""

    def __init__(self, make, old: dict):
        self.make, self.old = make, old

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        self[piece] = found = self.make(piece) if found is None else found
        return found


class ByteBPE:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once and remembered.

    The vocabulary merges within pieces of its pre-tokenizer only, so a text's ids are its pieces' ids in order. Texts of
    common Latin characters are split by a pattern of fixed classes, others by the vocabulary's own with Unicode's
    classes; texts with a special token's string go to the library whole.
    """

    KEEP = 300_000  # pieces after which a generation becomes the old one, checked text by text

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.any_pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The vocabulary's alphabet writes each byte as one visible character: printable Latin-1 stands for itself,
        # the other bytes, in order, are the characters from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.memo = _Memo(self._piece, {})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self._whole(text)
        out = b"".join(map(self.memo.__getitem__, self.any_pieces(text) if UNUSUAL(text) else PIECES(text)))
        if len(self.memo) > self.KEEP:
            self.memo = _Memo(self._piece, dict(self.memo))
        return out


_held: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """The worker process's encoder, which later tasks of it find with its pieces remembered (bounded as above)."""
    if path not in _held:
        _held.clear()
        _held[path] = ByteBPE(path)
    return _held[path]


def token_table(docs: DataFrame, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", planes: str = "byte", order: str = "doc_id") -> DataFrame:
    """The token table of ``docs`` (columns as above), not yet written. ``vocabulary`` is a path every executor has."""
    if order not in ("doc_id", "given"):
        raise ValueError("order is doc_id or given")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    by_id = ["doc_id", F.xxhash64("text")]
    ordered = rows if order == "given" else rows.repartitionByRange(*by_id).sortWithinPartitions(*by_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bpe, end = TaskContext.get().partitionId(), encoder(vocabulary), struct.pack("<I", end_id)
        chunk, first, held, listed, size = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            blob = pack_planes(np.frombuffer(b"".join(held), "<u4"), planes=planes)
            row = {"part": part, "chunk": chunk, "first": first, "n_ids": size, "docs": listed, "blob": blob}
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for d, ids in zip(some.column(0).to_pylist(), bpe.encode(texts), strict=True):
                    n = len(ids) // 4 + 1
                    listed.append({"doc_id": d, "offset": size, "n_tokens": n})
                    held += [ids, end]
                    size += n
                    if size >= CHUNK_IDS:
                        yield close()
                        chunk, first, held, listed, size = chunk + 1, first + size, [], [], 0
        if listed:
            yield close()

    return ordered.mapInArrow(run, CHUNK_SCHEMA)


def _arrow_schema() -> pa.Schema:
    doc = pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
    return pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(doc)), ("blob", pa.binary())])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, **options) -> None:
    """Write the token table to ``path``; the blobs are compressed already."""
    token_table(docs, vocabulary, **options).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row a document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (binary, u32)."""
    return _decode(spark.read.schema(CHUNK_SCHEMA).parquet(path), "doc_id long, part int, at long, n_tokens long, ids binary", lambda ids: ids.tobytes())


def _decode(table: DataFrame, schema: str, give) -> DataFrame:
    last = schema.rpartition(",")[2].split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c = batch.slice(row, 1).to_pylist()[0]
                ids = unpack_planes(c["blob"])
                out = [{"doc_id": d["doc_id"], "part": c["part"], "at": c["first"] + d["offset"], "n_tokens": d["n_tokens"], last: give(ids[d["offset"] : d["offset"] + d["n_tokens"]])} for d in c["docs"]]
                kind = pa.binary() if last == "ids" else pa.int64()
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), (last, kind)]))

    # One number a part: as many rows as the writer had tasks.
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, sums = 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        sums.append((r["part"], before))
        before += r["n"]
    starts = table.sparkSession.createDataFrame(sums, "part int, before long")
    rows = table.select("part", "first", "docs", "blob").mapInArrow(run, schema)
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", last)


def digests(spark, path: str) -> DataFrame:
    """As :func:`read_tokens`, with ``ids_crc32`` (unsigned CRC-32 of the ids' bytes) in place of the ids."""
    table = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    return _decode(table, "doc_id long, part int, at long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))


def encode_and_read_back(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the documents' ids to a fresh folder in the shared place and give the digests of what is read from there."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, vocabulary, **options)
    return digests(spark, path)

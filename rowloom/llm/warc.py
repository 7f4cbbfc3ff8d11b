"""WARC files and a Merkle fixity audit of replicas.

An archive is a folder of ``.warc.gz`` files (WARC/1.1, one gzip member a record) and an index table, as CDX files are:
``file``, ``seq`` (the record's number in its file), ``page_id``, ``offset``, ``length``. Each writing task makes files of about
``FILE_BYTES``, in the order of its input, so pages are not shuffled; files are written under a temporary name and
renamed, and their names and bytes follow from the task's input, so a retried task leaves nothing behind.

The audit reads the records of each replica where its index has them and hashes them into trees (SHA-256). A leaf is the
hash of the record's offset range and of the bytes stored there; sixteen neighbours at a time make a node, the hash of
its level, the ordered offset range it covers and its children, up to one root a file. Leaves and nodes begin
differently, so neither passes for the other; a record that is moved changes its tree as one whose bytes change does. Replica
roots are compared; below a root that differs only the children of differing nodes are compared, level by level, down
to the records.

Edge cases: null URLs and bodies are written as empty; repeated pages are records of their own; an empty table
has no files; a record or file that one replica lacks counts as a mismatch, also where its index names it; extra
columns go unread.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Folder, materialise, scratch

FANOUT = 16
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
CELL_BYTES = 1 << 30  # files up to this size are read through Spark, larger ones as streams
SMALL = 100_000  # rows up to which a table of differing nodes is broadcast
INDEX = "file string, seq long, page_id long, offset long, length long"
LEAVES = "file string, node long, page_id long, low long, high long, sha256 string, hash string"
_END = b"\r\n\r\n"
_PIECE = 1 << 20


# ---- records

def record_bytes(uri: str, payload: bytes, number: int = 0, date: str = DATE, content_type: str = "text/html; charset=utf-8") -> bytes:
    """One ``resource`` record. Its id follows from its content and number, so that a retry writes the same bytes."""
    digest = hashlib.sha256(payload).hexdigest()
    name = uuid.UUID(bytes=hashlib.sha256(f"{uri}\0{number}\0{digest}".encode()).digest()[:16], version=4)
    clean = uri.replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {clean}\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + _END


class _Plain:
    """Reads a file on, from a buffer."""

    def __init__(self, f):
        self.f, self.buffer, self.at = f, b"", 0

    def more(self) -> bool:
        piece = self.f.read(_PIECE)
        self.buffer += piece
        return bool(piece)

    def until(self, mark: bytes) -> int:
        """Length up to and with ``mark``, or -1 at the end of the file."""
        begin = 0
        while (found := self.buffer.find(mark, begin)) < 0:
            begin = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return -1
        return found + len(mark)

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(out)
        return out


def parse_records(f) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of an open plain file, or gzip file with a member a record. One record is held at a time."""
    source = _Plain(f)
    source.more()
    if source.buffer[:2] == b"\x1f\x8b":
        while source.buffer or source.more():
            begin, press, parts = source.at, zlib.decompressobj(31), []
            while not press.eof:
                if not source.buffer and not source.more():
                    raise ValueError(f"record at offset {begin} is cut short")
                piece = source.take(len(source.buffer))
                parts.append(press.decompress(piece))
                source.buffer = press.unused_data
                source.at -= len(source.buffer)
            for headers, payload in _whole(b"".join(parts), begin):
                yield begin, source.at - begin, headers, payload
        return
    while source.buffer or source.more():
        begin, size = source.at, source.until(_END)
        headers = _headers(source.take(size) if size > 0 else b"", begin)
        n = int(headers["content-length"])
        payload = source.take(n)
        if len(payload) < n or source.take(4) != _END:
            raise ValueError(f"record at offset {begin} is cut short")
        yield begin, source.at - begin, headers, payload


def _headers(head: bytes, at: int) -> dict[str, str]:
    if not head.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at offset {at}")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _whole(data: bytes, at: int) -> Iterator[tuple[dict[str, str], bytes]]:
    import io

    for _, _, headers, payload in parse_records(io.BytesIO(data)):
        yield headers, payload


def read_warc(spark, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files (a file a task): path, offset, length, type, uri, date, payload."""

    def rows(name: str, f) -> Iterator[pa.RecordBatch]:
        for offset, length, h, payload in parse_records(f):
            yield pa.RecordBatch.from_pylist([{"path": name, "offset": offset, "length": length, "type": h.get("warc-type"), "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "payload": payload}], schema=_RECORD)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from rows(name, io.BytesIO(data))

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                folder, _, file = name.rpartition("/")
                with Folder(folder).reading(file) as f:
                    yield from rows(name, f)

    kind = "path string, offset long, length long, type string, uri string, date string, payload binary"
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= CELL_BYTES).select("path", "content").mapInArrow(cells, kind)
    return small.union(files.where(F.col("length") > CELL_BYTES).select("path").mapInArrow(streams, kind))


_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("payload", pa.binary())])


def gzip_member(record: bytes) -> bytes:
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


# ---- archives

class Archive:
    """A folder of WARC files and their index."""

    def __init__(self, folder: Folder, index: DataFrame):
        self.folder, self.index = folder, index


def write_archive(pages: DataFrame, uri: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> Archive:
    """Write ``pages`` as .warc.gz files to the folder ``uri``."""
    folder = Folder(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, seq, offset, out = TaskContext.get().partitionId(), 0, 0, 0, []
        with ExitStack() as stack:
            f = None
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    for p, u, h in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                        if f is None:
                            name = f"part-{task:06}-{number:06}.warc.gz"
                            f = stack.enter_context(folder.writing(name))
                        member = gzip_member(record_bytes(u or "", (h or "").encode(), seq))
                        f.write(member)
                        out.append({"file": name, "seq": seq, "page_id": p, "offset": offset, "length": len(member)})
                        seq, offset = seq + 1, offset + len(member)
                        if offset >= file_bytes:
                            stack.close()
                            f, number, seq, offset = None, number + 1, 0, 0
                    yield pa.RecordBatch.from_pylist(out, schema=_INDEX)
                    out = []

    index = pages.select(F.col(f"`{page_id}`").cast("long"), F.col(f"`{url}`"), F.col(f"`{html}`")).mapInArrow(run, INDEX)
    return Archive(folder, materialise(index, "index"))


_INDEX = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def _by_file(index: DataFrame, extra: list) -> DataFrame:
    """The index, each file's rows in one task and in order (a file has a bounded size).

    The number of tasks is given, as the rows are small and would be put together, but not the files they stand for.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select(*[x.split()[0] for x in INDEX.split(", ")], *extra).repartition(tasks, "file").sortWithinPartitions("file", "seq")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    """Rows of each file in turn, in pieces."""
    for batch in batches:
        rows: list[dict] = []
        for r in batch.to_pylist():
            if rows and rows[-1]["file"] != r["file"]:
                yield rows[0]["file"], rows
                rows = []
            rows.append(r)
        if rows:
            yield rows[0]["file"], rows


def damaged_copy(archive: Archive, uri: str, one_in: int) -> Archive:
    """A replica to audit: about one record in ``one_in``, chosen by hash, has one byte in its middle changed."""
    source, target = archive.folder, Folder(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        with ExitStack() as stack:
            for name, rows in _files(batches):
                if name != current:
                    stack.close()
                    given, made, current = stack.enter_context(source.reading(name)), stack.enter_context(target.writing(name)), name
                for r in rows:
                    given.seek(r["offset"])
                    data = bytearray(given.read(r["length"]))
                    if r.pop("hit"):
                        data[len(data) // 2] ^= 1
                    made.write(data)
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    hit = F.pmod(F.xxhash64("page_id", "offset", "length"), F.lit(one_in)) == 0
    return Archive(target, materialise(_by_file(archive.index, [hit.alias("hit")]).mapInArrow(run, INDEX), "index"))


# ---- trees

def leaves(archive: Archive) -> DataFrame:
    """A leaf for each record of the index that its file holds: its range, the SHA-256 of the bytes there, and the leaf's hash."""
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = given = None
        with ExitStack() as stack:
            for name, rows in _files(batches):
                if name != current:
                    stack.close()
                    current = name
                    try:
                        given = stack.enter_context(folder.reading(name))
                    except FileNotFoundError:
                        given = None
                out = []
                for r in rows if given else ():
                    given.seek(r["offset"])
                    data = given.read(r["length"])
                    if len(data) < r["length"]:
                        continue  # the file ends before: the record is missing
                    low, high, digest = r["offset"], r["offset"] + r["length"], hashlib.sha256(data).hexdigest()
                    out.append({"file": name, "node": r["seq"], "page_id": r["page_id"], "low": low, "high": high, "sha256": digest, "hash": hashlib.sha256(f"leaf:{low}:{high}:{digest}".encode()).hexdigest()})
                yield pa.RecordBatch.from_pylist(out, schema=_LEAVES)

    return _by_file(archive.index, []).mapInArrow(run, LEAVES)


_LEAVES = pa.schema([("file", pa.string()), ("node", pa.int64()), ("page_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("sha256", pa.string()), ("hash", pa.string())])


def tree(bottom: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Levels of the trees over ``bottom`` (node, hash, low, high), leaves first; every tree ends in node 0 of the last level."""
    top = bottom.agg(F.max("node")).first()[0]
    levels = [bottom.select(*keys, "node", "hash", "low", "high")]
    while top is not None and (top > 0 or len(levels) == 1):
        ordered = F.sort_array(F.collect_list(F.struct("node", "hash")))  # FANOUT entries at most
        up = levels[-1].groupBy(*keys, F.floor(F.col("node") / FANOUT).cast("long").alias("node"))
        above = up.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.transform(ordered, lambda x: x["hash"]).alias("children"))
        hashed = F.sha2(F.concat_ws(":", F.lit("node"), F.lit(len(levels)), "low", "high", "children"), 256)
        levels.append(materialise(above.select(*keys, "node", hashed.alias("hash"), "low", "high"), f"level{len(levels)}"))
        top //= FANOUT
    return levels


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast where so few rows that it is checked; else joins shuffle."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _descend(levels: list[DataFrame]) -> DataFrame:
    differing = None
    for level in reversed(levels):
        if differing is not None:
            parents = differing.select("file", F.col("node").alias("parent")).distinct()
            level = level.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(_small(parents), ["file", "parent"], "left_semi")
        a = level.where("side = 0").select("file", "node", F.col("hash").alias("left_hash"), F.col("low").alias("l0"), F.col("high").alias("h0"))
        b = level.where("side = 1").select("file", "node", F.col("hash").alias("right_hash"), F.col("low").alias("l1"), F.col("high").alias("h1"))
        met = a.join(b, ["file", "node"], "full_outer").where("not (left_hash <=> right_hash)")
        differing = materialise(met.select("file", "node", F.coalesce("l0", "l1").alias("low"), F.coalesce("h0", "h1").alias("high"), "left_hash", "right_hash"), "differing")
    return differing


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of two tables of leaves those that differ: file, node, low, high (offsets), left_hash, right_hash (null where lacking)."""
    both = materialise(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select("side", "file", "node", "hash", "low", "high"), "leaves")
    return _descend(tree(both, ["side", "file"]))


def audit(left: Archive, right: Archive) -> DataFrame:
    """Every record of ``left``'s index, and those only ``right`` has: file, seq, page_id, offset, length, sha256 (as ``left`` has it), status ``ok``, ``corrupt`` or ``missing``."""
    first, second = materialise(leaves(left), "left"), materialise(leaves(right), "right")
    bad = _small(mismatches(first, second).select("file", F.col("node").alias("seq"), "left_hash", "right_hash"))
    lacking = F.col("left_hash").isNull() != F.col("right_hash").isNull()
    known = first.select("file", F.col("node").alias("seq"), "page_id", F.col("low").alias("offset"), (F.col("high") - F.col("low")).alias("length"), "sha256")
    listed = known.join(bad, ["file", "seq"], "left").withColumn("status", F.when(F.coalesce("left_hash", "right_hash").isNull(), "ok").when(lacking, "missing").otherwise("corrupt"))
    only = second.select("file", F.col("node").alias("seq"), "page_id", F.col("low").alias("offset"), (F.col("high") - F.col("low")).alias("length"))
    lost = only.join(bad.where("left_hash is null"), ["file", "seq"], "left_semi").withColumns({"sha256": F.lit(None).cast("string"), "status": F.lit("missing")})
    return listed.drop("left_hash", "right_hash").unionByName(lost)


def write_and_audit(pages: DataFrame, one_in: int) -> DataFrame:
    """Write an archive of ``pages`` and a replica of it with planted faults, read both back and audit them."""
    spark = pages.sparkSession
    first = write_archive(pages, scratch(spark, "archive"))
    return audit(first, damaged_copy(first, scratch(spark, "replica"), one_in))

import io
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rowloom.llm import queries, warc
from rowloom.llm.common import Folder

PAGES = [(1, "http://a/1", "<p>one</p>", 0), (2, None, None, 0), (3, "http://a/3\r\nX: y", "WARC/1.1\r\n\r\nnot a record", 0), (1, "http://a/1", "<p>one</p>", 0), (None, "http://é/", "x" * 300_000, 0)]


def archive(spark, folder, rows=PAGES, parts=2, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, seq int").coalesce(parts)
    return warc.write_archive(pages, str(folder), **options)


def numbered(n):
    return [(i, f"http://h/{i}", f"text {i}", 0) for i in range(n)]


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).iterdir()}


def test_records_round_trip(spark, tmp_path):
    a = archive(spark, tmp_path / "a", parts=1)
    (name, zipped), index = *files(tmp_path / "a").items(), a.index.orderBy("seq").collect()
    members = [zipped[r["offset"] : r["offset"] + r["length"]] for r in index]
    assert name.endswith(".warc.gz") and b"".join(members) == zipped and [r["page_id"] for r in index] == [r[0] for r in PAGES]
    plain = b"".join(zlib.decompress(m, 31) for m in members)
    (tmp_path / "b.warc").write_bytes(plain)
    want = [(h or "").encode() for _, _, h, _ in PAGES]
    for path, data in ((tmp_path / "a", zipped), (tmp_path / "b.warc", plain)):
        assert [p for *_, p in warc.parse_records(io.BytesIO(data))] == want
        rows = warc.read_warc(spark, str(path)).orderBy("offset").collect()
        assert [bytes(r["payload"]) for r in rows] == want
        for r in rows:
            piece = data[r["offset"] : r["offset"] + r["length"]]
            assert [bytes(p) for *_, p in warc.parse_records(io.BytesIO(piece))] == [bytes(r["payload"])]
        with pytest.raises(ValueError):
            list(warc.parse_records(io.BytesIO(data[:-20])))
    assert [(r["offset"], r["length"]) for r in warc.read_warc(spark, str(tmp_path / "a")).orderBy("offset").collect()] == [(r["offset"], r["length"]) for r in index]


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    archive(spark, tmp_path / "a")
    want = sorted(bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / "a")).collect())
    monkeypatch.setattr(warc, "CELL_BYTES", 10)
    assert sorted(bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / "a")).collect()) == want


def test_files_are_rolled(spark, tmp_path):
    a = archive(spark, tmp_path / "a", numbered(50), parts=1, file_bytes=2000)
    held, at = files(tmp_path / "a"), {}
    assert len(held) > 3
    for r in a.index.orderBy("file", "seq").collect():
        assert r["offset"] == at.get(r["file"], 0)
        at[r["file"]] = r["offset"] + r["length"]
    assert at == {k: len(v) for k, v in held.items()}


@pytest.mark.parametrize("n", [1, 16, 17, 600])
def test_audit_finds_exactly_the_damage(spark, tmp_path, n):
    good = archive(spark, tmp_path / "good", numbered(n))
    assert warc.mismatches(warc.leaves(good), warc.leaves(good)).count() == 0
    bad = warc.damaged_copy(good, str(tmp_path / "bad"), 10**9)
    assert files(tmp_path / "good") == files(tmp_path / "bad")
    places = {r["page_id"]: r for r in good.index.collect()}
    wanted = {0, 5, n - 1} & set(range(n))
    for i in wanted:
        path = tmp_path / "bad" / places[i]["file"]
        data = bytearray(path.read_bytes())
        data[places[i]["offset"] + 12] ^= 4
        path.write_bytes(data)
    lost = warc.Archive(bad.folder, bad.index.where("page_id <> 7"))
    for left, right in ((good, lost), (lost, good)):
        status = {r["page_id"]: r["status"] for r in warc.audit(left, right).collect()}
        assert {i for i, s in status.items() if s == "corrupt"} == wanted and len(status) == n
        assert {i for i, s in status.items() if s == "missing"} == {7} & set(range(n))
    found = warc.mismatches(warc.leaves(good), warc.leaves(lost))
    assert found.count() == len(wanted | {7} & set(range(n)))


def test_moved_offsets_and_lost_files_are_mismatches(spark, tmp_path):
    good = archive(spark, tmp_path / "good", numbered(100))
    moved = warc.leaves(good).withColumns({"low": F.col("low") + 5, "high": F.col("high") + 5})
    rehashed = moved.withColumn("hash", F.sha2(F.concat_ws(":", F.lit("leaf"), "low", "high", "sha256"), 256))
    same = warc.leaves(good).withColumn("hash", F.sha2(F.concat_ws(":", F.lit("leaf"), "low", "high", "sha256"), 256))
    assert warc.mismatches(warc.leaves(good), same).count() == 0
    assert warc.mismatches(warc.leaves(good), rehashed).count() == 100
    first, second = (warc.tree(x.withColumn("side", F.lit(0)), ["side", "file"])[-1].collect() for x in (warc.leaves(good), moved))  # equal leaf hashes, moved ranges
    assert {r["hash"] for r in first}.isdisjoint(r["hash"] for r in second)
    copy = warc.damaged_copy(good, str(tmp_path / "copy"), 10**9)
    name = sorted(files(tmp_path / "copy"))[0]
    (tmp_path / "copy" / name).unlink()
    rows = warc.audit(good, copy).collect()
    assert {r["file"] for r in rows if r["status"] == "missing"} == {name} and {r["status"] for r in rows if r["file"] != name} <= {"ok"}
    cut = tmp_path / "good" / name
    cut.write_bytes(cut.read_bytes()[:-3])
    assert warc.leaves(good).count() == 99


def test_query_matches_direct_comparison(spark, sf_dir, tmp_path):
    rows = queries.op3_warc_audit(spark, sf_dir).collect()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert len(rows) == pages.count() and all(r["status"] in ("ok", "corrupt") for r in rows)
    first = warc.write_archive(pages, str(tmp_path / "a"))
    second = warc.damaged_copy(first, str(tmp_path / "b"), 20)
    a, b = files(tmp_path / "a"), files(tmp_path / "b")
    index = first.index.collect()
    piece = lambda held, r: held[r["file"]][r["offset"] : r["offset"] + r["length"]]
    want = {(r["file"], r["seq"]) for r in index if piece(a, r) != piece(b, r)}
    got = warc.audit(first, second).collect()
    assert want and {(r["file"], r["seq"]) for r in got if r["status"] == "corrupt"} == want and len(got) == len(index)


def test_edge_cases(spark, tmp_path):
    empty = archive(spark, tmp_path / "none", PAGES[:0])
    full = archive(spark, tmp_path / "full")
    assert warc.audit(empty, empty).count() == 0
    for rows in (warc.audit(full, empty).collect(), warc.audit(empty, full).collect()):
        assert len(rows) == len(PAGES) and {r["status"] for r in rows} == {"missing"}
    lone = warc.Archive(Folder(str(tmp_path / "gone")), full.index)
    assert {r["status"] for r in warc.audit(full, lone).collect()} == {"missing"}

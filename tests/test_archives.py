"""Archives as rows and rows as archives, the catalogue of results, and pictures."""

from __future__ import annotations

import glob
import hashlib
import io
import json
import os
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest

from roadsift.operators import raster
from roadsift.sources import archives, results
from roadsift.sources.archives import ArchiveError, ArchiveSource
from roadsift.sources.tables import write_json

BODIES = {f"data/samples/{k:02d}.bin": bytes([k]) * (k * 37) for k in range(12)} | {"data/v1.0-mini/scene.json": b"[]", "notes.txt": "ü".encode()}


def zipped(path, files):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_rows_to_archives_and_back(spark, tmp_path, kind):
    spark.dataSource.register(ArchiveSource)
    rows = spark.createDataFrame(list(BODIES.items()), "member string, content binary").repartition(3)
    target = f"{tmp_path}/out"
    rows.write.format("archive").option("path", target).option("kind", kind).mode("append").save()
    assert not glob.glob(f"{target}/.*")  # nothing of the first phase is left
    manifest = json.load(open(glob.glob(f"{target}/manifest-*.json")[0]))["parts"]
    for part in manifest:
        assert hashlib.sha256(open(f"{target}/{part['name']}", "rb").read()).hexdigest() == part["sha256"]
    got = archives.members(spark, target, split_bytes=300)
    assert got.rdd.getNumPartitions() > 3  # members, not archives, make the partitions
    assert {r["member"]: bytes(r["content"]) for r in got.collect()} == BODIES
    listing = archives.members(spark, target, content=False).collect()
    assert {r["member"]: r["size"] for r in listing} == {n: len(b) for n, b in BODIES.items()} and all(r["content"] is None for r in listing)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(ArchiveSource)
    for bad in ([("a/../../x", b"1"), ("b", b"2")], [("same", b"1"), ("same", b"2")]):
        rows = spark.createDataFrame(bad, "member string, content binary").coalesce(1)
        with pytest.raises(Exception, match="unsafe member name|two members"):
            rows.write.format("archive").option("path", f"{tmp_path}/out").mode("append").save()
    assert not os.path.exists(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []


@pytest.mark.parametrize("name", ["../x", "a/../../x", "/etc/x", "C:\\x", "a\\..\\..\\x", "..\\x", "/"])
def test_names_that_leave_the_folder_are_refused(spark, tmp_path, name):
    with pytest.raises(ArchiveError):
        archives.safe_name(name)
    if name != "/":
        zipped(f"{tmp_path}/a.zip", {"good": b"1", name: b"2"})
        with pytest.raises(Exception, match="unsafe member name"):
            archives.members(spark, f"{tmp_path}/a.zip").collect()


def test_links_other_formats_and_broken_archives_are_refused(spark, tmp_path):
    with tarfile.open(f"{tmp_path}/l.tar", "w") as t:
        link = tarfile.TarInfo("data/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    with pytest.raises(Exception, match="link or device"):
        archives.members(spark, f"{tmp_path}/l.tar").collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="not a zip archive"):
        archives.members(spark, f"{tmp_path}/b").collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.part1.rar").write_bytes(b"")
    with pytest.raises(Exception, match="only zip and tar"):
        archives.members(spark, f"{tmp_path}/c").collect()
    (tmp_path / "d").mkdir()
    assert archives.members(spark, f"{tmp_path}/d").count() == 0


def test_last_tree_wins(spark, tmp_path):
    zipped(f"{tmp_path}/1.zip", {"data/samples/a": b"1", "data/samples/b": b"1", "other/data/c": b"1", "readme": b"1"})
    zipped(f"{tmp_path}/2.zip", {"set/data/samples/b": b"22", "set/data/v1.0-x/t.json": b"22", "deep/er/data/samples/z": b"22"})
    with tarfile.open(f"{tmp_path}/3.tar", "w") as t:
        for name in ("data/v1.0-x/t.json", "data/samples/q"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"333"))
    got = {r["path"]: (r["archive"], r["size"]) for r in archives.merged(archives.members(spark, f"{tmp_path}/*", content=False)).collect()}
    assert got == {"samples/a": ("1.zip", 1), "samples/b": ("2.zip", 2), "v1.0-x/t.json": ("3.tar", 3), "samples/q": ("3.tar", 3)}


def test_parts_against_a_manifest(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"a")
    (tmp_path / "b.zip").write_bytes(b"b")
    manifest = spark.createDataFrame([("a.zip", hashlib.sha256(b"a").hexdigest().upper()), ("b.zip", "0"), ("c.zip", "0")], "name string, sha256 string")
    parts = spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")
    assert {tuple(r) for r in archives.check_parts(parts, manifest).collect()} == {("b.zip", "damaged"), ("c.zip", "missing")}


def test_catalogue_of_selections(spark, tmp_path):
    root = f"{tmp_path}/selections"
    assert results.list_selections(spark, root).count() == 0
    rows = spark.createDataFrame([("t1", 1)], "token string, rank int")
    ids = ["0123456789ab", "ba9876543210", "aaaaaaaaaaaa"]
    for k, sid in enumerate(ids):
        results.store_selection(spark, root, sid, rows, {"k": k})
        os.utime(f"{root}/{sid}/result.json", (1_700_000_000 + k // 2, 1_700_000_000 + k // 2))  # the first two at the same time
    rows.write.parquet(f"{root}/ffffffffffff/selected.parquet")  # half-written: no result yet
    for bad, text in (("not-an-id", "{}"), ("bbbbbbbbbbbb", "{broken"), ("cccccccccccc", "[1]"), ("dddddddddddd", '{"params": 3}')):
        os.makedirs(f"{root}/{bad}")
        with open(f"{root}/{bad}/result.json", "w") as f:
            f.write(text)
        os.utime(f"{root}/{bad}/result.json", (1_600_000_000, 1_600_000_000))
    listed = results.list_selections(spark, root).collect()
    assert [r["selection_id"] for r in listed] == ["aaaaaaaaaaaa", "ba9876543210", "0123456789ab", "dddddddddddd"]
    assert [json.loads(r["params"]) for r in listed] == [{"k": 2}, {"k": 1}, {"k": 0}, {}]
    text, chosen = results.get_selection(spark, root, "aaaaaaaaaaaa")
    assert json.loads(text)["selection_id"] == "aaaaaaaaaaaa" and chosen.collect() == rows.collect()
    for bad in ("ffffffffffff", "../../etc", "AAAAAAAAAAAA", "eeeeeeeeeeee"):
        with pytest.raises(results.NotThereError):
            results.get_selection(spark, root, bad)
    with pytest.raises(ValueError, match="not a selection id"):
        results.store_selection(spark, root, "../x", rows, {})
    source = tmp_path / "in"
    source.write_text("x")
    folder = f"{root}/aaaaaaaaaaaa"
    assert results.stale(spark, folder, [str(source)])  # newer than the result
    os.utime(source, (1_600_000_000, 1_600_000_000))
    assert not results.stale(spark, folder, [str(source)]) and results.stale(spark, folder, [str(tmp_path / "gone")]) and results.stale(spark, f"{root}/ffffffffffff", [])


def test_choice_of_an_experiment(spark, tmp_path):
    for name, version, files in (("a", "v1", ["w.bin"]), ("b", "v1", ["w.bin", "s.json"]), ("c", "v2", ["w.bin", "s.json"])):
        os.makedirs(f"{tmp_path}/{name}")
        for f in files:
            (tmp_path / name / f).write_text("x")
        (tmp_path / name / "config.json").write_text(json.dumps({"version": version}))
    folders, needed = [f"{tmp_path}/{n}" for n in "abc"], ["w.bin", "s.json"]
    assert results.first_complete(spark, folders, needed, "v1") == (folders[1], "") and results.first_complete(spark, folders, needed, "v2") == (folders[2], "")
    assert results.first_complete(spark, folders, needed, None) == (folders[1], "")
    assert results.first_complete(spark, folders, needed, "v3") == (None, "no model for v3 (there is b = v1, c = v2)")
    assert results.first_complete(spark, folders[:1], needed, "v1") == (None, f"missing: {folders[0]}/s.json")


def test_json_is_replaced_without_a_gap(spark, tmp_path):
    path = f"{tmp_path}/r.json"
    for k in range(3):
        write_json(spark, {"k": k, "x": float("nan")}, path)
        assert json.load(open(path)) == {"k": k, "x": None}
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["r.json"]


def decoded(body):
    """A PNG by its definition: checks every checksum and undoes the filters that are used."""
    assert body[:8] == raster.SIGNATURE
    at, data = 8, b""
    while at < len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        chunk = body[at + 8 : at + 8 + size]
        assert struct.unpack(">I", body[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + chunk)
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", chunk)
            assert depth == 8 and rest == [0, 0, 0]
        data += chunk if kind == b"IDAT" else b""
        at += 12 + size
    channels = 3 if colour == 2 else 1
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    assert set(raw[:, 0]) <= {2}
    rows = np.cumsum(raw[:, 1:].astype(np.uint32), axis=0).astype(np.uint8)
    return rows.reshape((height, width, 3) if channels == 3 else (height, width))


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (4, 6, 3), (300, 2, 3)])
def test_png_round_trip(shape):
    image = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (decoded(raster.png(image)) == image).all()


def test_top_view_equals_the_grid(spark):
    rng = np.random.default_rng(1)
    points = [(f"t{k % 3}", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-11, 11, (900, 2)))] + [("t0", 0.05, 0.05)] * 50
    got = {r["t"]: decoded(bytes(r["png"])) for r in raster.top_view(spark.createDataFrame(points, "t string, x double, y double"), "t", "x", "y", 20, 10.0).collect()}
    for token in ("t0", "t1", "t2"):
        grid = np.zeros((20, 20))
        for t, x, y in points:
            if t == token and -10 <= x < 10 and -10 <= y < 10:
                grid[int(np.floor(x + 10)), int(np.floor(y + 10))] += 1
        shade = np.log1p(grid)
        assert (got[token] == (255 * shade / shade.max()).astype(np.uint8)[::-1, ::-1]).all()


def test_thumbnails_skip_what_is_there(spark):
    rng = np.random.default_rng(2)
    big = rng.integers(0, 256, (36, 64, 3)).astype(np.uint8)
    rows = [("a", big.tobytes(), 36, 64), ("b", big[:9, :16].tobytes(), 9, 16), ("broken", b"123", 5, 5), ("none", None, 1, 1), ("done", b"not read", 36, 64)]
    df = spark.createDataFrame(rows, "k string, p binary, h int, w int")
    got = {r["k"]: r["png"] for r in raster.thumbnails(df, "k", "p", "h", "w", df.filter("k = 'done'"), (18, 32)).collect()}
    assert set(got) == {"a", "b", "broken", "none"} and got["broken"] is None and got["none"] is None
    assert (decoded(bytes(got["a"])) == np.rint(big.reshape(18, 2, 32, 2, 3).astype(float).mean((1, 3)))).all()
    assert (decoded(bytes(got["b"])) == big[:9, :16]).all()  # small images are not enlarged
    assert raster.shrunk(big, 10, 1000).shape == (10, 18, 3) and abs(raster.shrunk(big, 7, 11).mean() - big.mean()) < 1

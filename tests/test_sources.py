import gzip
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from gridloom.operators import ledger
from gridloom.operators.voxels import write_tiles
from gridloom.sources import binary as B
from gridloom.streaming.tiles import work_on_arrival


def tag(kind, value):
    if kind == 10:
        return b"".join(bytes([k]) + struct.pack(">H", len(n)) + n.encode() + tag(k, v) for n, (k, v) in value.items()) + b"\0"
    if kind == 9:
        inner, items = value
        return bytes([inner]) + struct.pack(">i", len(items)) + b"".join(tag(inner, v) for v in items)
    if kind == 8:
        return struct.pack(">H", len(value)) + value.encode()
    if kind in (7, 11, 12):
        return struct.pack(f">i{len(value)}{'biq'[(kind - 7) // 2 if kind == 7 else kind - 10]}", len(value), *value)
    return struct.pack({1: ">b", 2: ">h", 3: ">i", 4: ">q"}[kind], value)


def document(value):
    return gzip.compress(b"\x0a\0\0" + tag(10, value))


def test_templates(spark, tmp_path):
    structure = {"palette": (9, (10, [{"Name": (8, "m:log"), "Properties": (10, {"axis": (8, "y")})}, {"Name": (8, "m:air")}])), "blocks": (9, (10, [{"pos": (9, (3, [1, 2, 3])), "state": (3, 0)}, {"pos": (9, (3, [0, 0, 0])), "state": (3, 1)}]))}
    sponge = {"Width": (2, 2), "Height": (2, 1), "Length": (2, 2), "Palette": (10, {"m:air": (3, 0), "m:leaf[a=1, b=x]": (3, 200)}), "BlockData": (7, [0, -56, 1, 0, -56, 1])}
    numbers = [k % 5 for k in range(27)]
    packed = sum(v << (3 * k) for k, v in enumerate(numbers))
    words = [(packed >> (64 * k)) & (2**64 - 1) for k in range(2)]
    signed = [w - 2**64 if w >= 2**63 else w for w in words]
    lite = {"Regions": (10, {"r": (10, {"Size": (10, {"x": (3, 3), "y": (3, -3), "z": (3, 3)}), "BlockStatePalette": (9, (10, [{"Name": (8, f"m:{n}")} for n in ("air", "b", "c", "d", "e")])), "BlockStates": (12, signed)})})}
    for name, value in (("a.nbt", structure), ("b.schem", sponge), ("c.litematic", lite)):
        (tmp_path / name).write_bytes(document(value))
    (tmp_path / "bad.nbt").write_bytes(b"\x0a\0")
    got = {}
    found = B.templates(B.files(spark, str(tmp_path))).collect()
    assert [r.path[-7:] for r in found if r.error] == ["bad.nbt"]
    for r in (r for r in found if not r.error):
        got.setdefault(r.path[-5:], set()).add((r.x, r.y, r.z, r.name, tuple(sorted(r.props.items()))))
    assert got["a.nbt"] == {(1, 2, 3, "m:log", (("axis", "y"),))}
    assert got["schem"] == {(1, 0, 0, "m:leaf", (("a", "1"), ("b", "x"))), (1, 0, 1, "m:leaf", (("a", "1"), ("b", "x")))}
    assert got["matic"] == {(k % 3, k // 9, k // 3 % 3, "m:" + "abcde"[v] if v else "", ()) for k, v in enumerate(numbers) if v}


def test_regions(spark, tmp_path):
    whole = bytearray(B.region_bytes([(0, 5, b"first"), (33, 6, b"x" * 9000), (1023, 7, b"")]))
    struct.pack_into(">I", whole, 4 * 7, 999 << 8 | 1)  # a slot beyond the end
    (tmp_path / "r.0.0.mca").write_bytes(whole)
    (tmp_path / "short.mca").write_bytes(b"123")
    rows = {r.slot: r for r in B.regions(B.files(spark, str(tmp_path), "*.mca")).collect()}
    assert {k: (r.cx, r.cz, r.timestamp, bytes(r.payload)) for k, r in rows.items()} == {0: (0, 0, 5, b"first"), 33: (1, 1, 6, b"x" * 9000), 1023: (31, 31, 7, b"")}


def test_varints_bits_and_states():
    assert B.varints(bytes([0, 127, 128, 1, 255, 255, 3, 128])).tolist() == [0, 127, 128, 65535]
    assert B.varints(b"").tolist() == B.varints(b"\x80").tolist() == []
    assert B.bit_packed([-1, 1], 5, 13).tolist() == [31] * 13 and B.bit_packed([-1], 5, 15).tolist() == [31] * 12 + [15, 0, 0]
    rng = np.random.default_rng(1)
    for bits in (2, 3, 7, 13, 31):
        want = rng.integers(0, 2**bits, 200).tolist()
        whole = sum(v << (bits * k) for k, v in enumerate(want))
        assert B.bit_packed([whole >> (64 * k) & (2**64 - 1) for k in range(bits * 200 // 64 + 1)], bits, 200).tolist() == want
    assert B.state("m:log[axis=y, lit = true]") == ("m:log", {"axis": "y", "lit": "true"})
    assert B.state("m:air") == ("m:air", {})


def test_archives_and_rasters(spark, tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a/b/x.png", b"1")
        z.writestr("a/b/c/y.png", b"2")
        z.writestr("a/b/x.txt", b"3")
    (tmp_path / "t.jar").write_bytes(packed.getvalue())
    assert [(r.entry, bytes(r.content)) for r in B.archives(B.files(spark, str(tmp_path), "*.jar"), "a/", ".png", 2).collect()] == [("a/b/x.png", b"1")]
    px = [[0, 65535, 300], [7, 8, 9]]
    lines = b"\0" + struct.pack(">3H", *px[0]) + b"\2" + bytes((a - b) & 255 for a, b in zip(struct.pack(">3H", *px[1]), struct.pack(">3H", *px[0]), strict=True))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    (tmp_path / "h.png").write_bytes(raw)
    got = {(r.x, r.z): r.px for r in B.png16(B.files(spark, str(tmp_path), "*.png")).collect()}
    assert got == {(x, z): px[z][x] for z in range(2) for x in range(3)}


def test_raster_filters_and_broken_files(spark):
    """All five line filters, several data chunks, rasters that are cut off or none at all."""
    rng = np.random.default_rng(2)
    px = rng.integers(0, 65536, (11, 7))
    lines, above, out = px.astype(">u2").view(np.uint8).reshape(11, -1).astype(int), np.zeros(14, dtype=int), b""
    for k, line in enumerate(lines):
        left, corner = np.concatenate([[0, 0], line[:-2]]), np.concatenate([[0, 0], above[:-2]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        out += bytes([k % 5]) + ((line - [np.zeros(14, dtype=int), left, above, (left + above) // 2, near][k % 5]) & 255).astype(np.uint8).tobytes()
        above = line
    packed = zlib.compress(out)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = B.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 11, 16, 0, 0, 0, 0)) + chunk(b"IDAT", packed[:40]) + chunk(b"IDAT", packed[40:]) + chunk(b"IEND", b"")
    colour = B.png_bytes(np.zeros((2, 2, 3), dtype=int))
    files = [("a", raw), ("b", B.png_bytes(px)), ("cut", raw[:60]), ("none", b"x"), ("null", None), ("colour", colour)]
    found = B.png16(spark.createDataFrame([(n, None if r is None else bytearray(r)) for n, r in files], "path string, content binary")).collect()
    for name in "ab":
        assert {(r.x, r.z): r.px for r in found if r.path == name and r.error is None} == {(x, z): px[z, x] for z in range(11) for x in range(7)}
    assert {r.path for r in found if r.error} == {"cut", "none", "null", "colour"}


def test_array_files(spark):
    px = np.arange(12, dtype=np.int16).reshape(3, 4)
    files = [("a", B.array_bytes({"v": px}, compressed=False)), ("b", B.array_bytes({"one": px, "two": px > 5})), ("c", B.array_bytes({"line": px[0]}))]
    found = B.arrays(spark.createDataFrame([(n, bytearray(r)) for n, r in files], "path string, content binary")).collect()
    cells = lambda a: {(x, z, float(a[x, z])) for x in range(3) for z in range(4)}
    for path, name, want in (("a", None, px), ("b", "one", px), ("b", "two", px > 5)):
        assert {(r.x, r.z, r.value) for r in found if r.path == path and r["name"] == name} == cells(want)
    assert [r.path for r in found if r.error] == ["c"]


def test_broken_containers_are_rows(spark):
    bad = spark.createDataFrame([("a", bytearray(b"no zip")), ("b", None), ("c", bytearray())], "path string, content binary")
    assert {r.path for r in B.archives(bad, "", "", 0).collect() if r.error} == {"a", "b", "c"}
    assert {r.path for r in B.templates(bad).collect() if r.error} == {"a", "b", "c"}
    assert {r.path for r in B.world(bad).collect() if r.error} == {"a", "b", "c"}
    assert {r.path for r in B.arrays(bad).collect() if r.error} == {"a", "b", "c"}
    assert B.templates(bad.limit(0)).count() == B.png16(bad.limit(0)).count() == 0


def test_fingerprint_changes_with_any_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(name.encode())
    seen = {B.fingerprint(B.files(spark, str(tmp_path)), "1").first()[0], B.fingerprint(B.files(spark, str(tmp_path)), "2").first()[0]}
    (tmp_path / "b").write_bytes(b"c")
    seen.add(B.fingerprint(B.files(spark, str(tmp_path)), "1").first()[0])
    assert len(seen) == 3


def test_ledger_resumes(spark, tmp_path):
    tiles = spark.createDataFrame([(16 * i, 16 * k) for i in range(3) for k in range(3)], "x0 int, z0 int")
    done, path = [], str(tmp_path / "ledger")
    assert ledger.run_pending(tiles, path, lambda part: done.extend(r.tile_key for r in part.collect()), batch=4) == 3
    assert len(done) == 9 == len(set(done))
    assert ledger.run_pending(tiles, path, lambda part: pytest.fail("all is done")) == 0
    ledger.check_signature(spark, str(tmp_path / "meta"), "one")
    ledger.check_signature(spark, str(tmp_path / "meta"), "one")
    with pytest.raises(ValueError, match="belongs"):
        ledger.check_signature(spark, str(tmp_path / "meta"), "two")


def test_ledgers_are_written_sorted_and_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k % 30},{k % 7}",) for k in range(500)], "tile_key string").repartition(4)
    ledger.persist_sorted(rows, str(tmp_path / "keys"))
    lines = [line for file in sorted((tmp_path / "keys").glob("part-*")) for line in file.read_text().split()]
    assert lines == sorted({f"{k % 30},{k % 7}" for k in range(500)})


def test_tiles_as_a_stream(spark, tmp_path):
    seen, source = [], str(tmp_path / "in")
    work = lambda part: seen.extend(r.x0 for r in part.collect())
    for lot in ([1, 2], [3]):
        spark.createDataFrame([(v,) for v in lot], "x0 int").write.mode("append").parquet(source)
        work_on_arrival(spark, source, "x0 int", str(tmp_path / "check"), work).awaitTermination(60)
    assert sorted(seen) == [1, 2, 3]


def test_written_tiles_are_replaced_alone(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    path = str(tmp_path / "tiles")
    write_tiles(spark.createDataFrame([(0, 0, 1), (20, 0, 2)], "x int, z int, v int"), path, 16)
    write_tiles(spark.createDataFrame([(1, 1, 3)], "x int, z int, v int"), path, 16)
    assert sorted((r.x, r.v) for r in spark.read.parquet(path).collect()) == [(1, 3), (20, 2)]

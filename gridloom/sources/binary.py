"""Readers of binary containers: files as rows (path, content), contents as rows of what they hold.

Files come from Spark's binaryFile source, so they may lie wherever Spark reads; decoding is an Arrow pass over contents
without a shuffle. A content that doesn't decode gives a row with its error.
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTOR = 4096


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def inventory(found: DataFrame) -> DataFrame:
    """One row: how many files, and their bytes; contents are not read."""
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists, wherever Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            return path
    return None


def regions(contents: DataFrame) -> DataFrame:
    """(path, slot, cx, cz, offset, timestamp, compression, payload, error) of the used slots of region files.

    The header's first sector holds 1024 places, three bytes of sector offset and one of sector count, big-endian; the
    second their timestamps. A payload is preceded by its length and a byte of compression: 1 gzip, 2 zlib, 3 none.
    """
    return _region_slots(contents, None)


def _region_slots(contents: DataFrame, wanted: list[int] | None) -> DataFrame:
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, raw in zip(part["path"], part["content"], strict=True):
                if raw is None or len(raw) < 2 * SECTOR:
                    continue
                rows = []
                for slot in range(1024) if wanted is None else wanted:
                    place, stamp = struct.unpack_from(">I", raw, 4 * slot)[0], struct.unpack_from(">I", raw, SECTOR + 4 * slot)[0]
                    at = (place >> 8) * SECTOR
                    if not place >> 8 or not place & 255 or at + 5 > len(raw):
                        continue
                    size, kind = struct.unpack_from(">IB", raw, at)
                    body, error = raw[at + 5 : at + 4 + size], None
                    try:
                        body = gzip.decompress(body) if kind == 1 else zlib.decompress(body) if kind == 2 else body
                    except (OSError, zlib.error, EOFError) as e:
                        body, error = None, str(e)
                    rows.append((path, slot, slot & 31, slot >> 5, at, stamp, kind, body, error))
                yield pd.DataFrame(rows, columns=["path", "slot", "cx", "cz", "offset", "timestamp", "compression", "payload", "error"])

    return contents.select("path", "content").mapInPandas(read, "path string, slot int, cx int, cz int, offset long, timestamp long, compression int, payload binary, error string")


def region_bytes(slots: list[tuple[int, int, bytes]]) -> bytes:
    """A region file of (slot, timestamp, uncompressed payload), sectors one after another in slot order."""
    places, stamps, body, sector = bytearray(SECTOR), bytearray(SECTOR), bytearray(), 2
    for slot, stamp, payload in sorted(slots):
        packed = zlib.compress(payload)
        block = struct.pack(">IB", len(packed) + 1, 2) + packed
        block += bytes(-len(block) % SECTOR)
        count = len(block) // SECTOR
        struct.pack_into(">I", places, 4 * slot, sector << 8 | min(count, 255))
        struct.pack_into(">I", stamps, 4 * slot, stamp)
        body += block
        sector += count
    return bytes(places + stamps + body)


def chunk_at(contents: DataFrame, cx: int, cz: int) -> DataFrame:
    """(path, slot, ..., payload, error): the one chunk at (cx, cz) of region files, without decoding any other.

    A chunk's slot comes from the low five bits of its coordinates. No row where the slot is unused.
    """
    slot = (cx & 31) + (cz & 31) * 32
    return _region_slots(contents, [slot])


def rewrite_counts(regions_: DataFrame, keep: Column) -> DataFrame:
    """(path, kept, dropped, removed) a file: what a rewrite with this condition keeps and drops, and whether nothing stays.

    Slots that don't decode are dropped.
    """
    stays = F.coalesce(F.col("error").isNull() & keep, F.lit(False))
    return regions_.groupBy("path").agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("dropped")).withColumn("removed", F.col("kept") == 0)


def compacted(regions_: DataFrame, keep: Column) -> DataFrame:
    """(path, content) of region files rewritten with only the slots that keep holds for; files without any are gone."""

    def write(part: pd.DataFrame) -> pd.DataFrame:
        slots = list(zip(part["slot"], part["timestamp"], part["payload"], strict=True))
        return pd.DataFrame({"path": [part["path"].iloc[0]], "content": [region_bytes(slots)]})

    rows = regions_.where(F.col("error").isNull() & keep).select("path", "slot", "timestamp", "payload")
    return rows.groupBy("path").applyInPandas(write, "path string, content binary")


class _Tags:
    """Named binary tags: big-endian, typed by a byte, names before values."""

    _NUMBERS = {1: ">b", 2: ">h", 3: ">i", 4: ">q", 5: ">f", 6: ">d"}

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str):
        (value,) = struct.unpack_from(form, self.raw, self.at)
        self.at += struct.calcsize(form)
        return value

    def text(self) -> str:
        n = self.take(">H")
        self.at += n
        return self.raw[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind in self._NUMBERS:
            return self.take(self._NUMBERS[kind])
        if kind == 8:
            return self.text()
        if kind in (7, 11, 12):
            form = {7: "b", 11: "i", 12: "q"}[kind]
            n = self.take(">i")
            out = struct.unpack_from(f">{n}{form}", self.raw, self.at)
            self.at += n * struct.calcsize(f">{form}")
            return list(out)
        if kind == 9:
            inner = self.take(">b")
            return [self.value(inner) for _ in range(self.take(">i"))]
        if kind == 10:
            out = {}
            while inner := self.take(">b"):
                name = self.text()
                out[name] = self.value(inner)
            return out
        raise ValueError(f"no such tag: {kind}")


def tags(raw: bytes) -> dict:
    """The root compound; gzip and zlib are told by their first bytes."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    elif raw[:1] == b"\x78":
        raw = zlib.decompress(raw)
    reader = _Tags(raw)
    kind = reader.take(">b")
    reader.text()
    return reader.value(kind)


def tag_bytes(root: dict, name: str = "") -> bytes:
    """An uncompressed root compound. Numbers are ints, lists of ints int arrays, bytes byte arrays, other lists lists."""

    def text(v: str) -> bytes:
        raw = v.encode()
        return struct.pack(">H", len(raw)) + raw

    def value(v) -> tuple[int, bytes]:
        if isinstance(v, dict):
            return 10, b"".join(bytes([kind]) + text(k) + body for k, (kind, body) in ((k, value(x)) for k, x in v.items())) + b"\0"
        if isinstance(v, str):
            return 8, text(v)
        if isinstance(v, bytes):
            return 7, struct.pack(">i", len(v)) + v
        if isinstance(v, np.ndarray):
            return 12, struct.pack(">i", len(v)) + v.astype(">i8").tobytes()
        if isinstance(v, list):
            made = [value(x) for x in v]
            return 9, bytes([made[0][0] if made else 0]) + struct.pack(">i", len(v)) + b"".join(b for _, b in made)
        return 3, struct.pack(">i", v)

    return b"\x0a" + text(name) + value(root)[1]


def world(contents: DataFrame) -> DataFrame:
    """(path, name, version, error) of worlds' metadata files."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, raw in zip(part["path"], part["content"], strict=True):
                try:
                    data = tags(raw)["Data"]
                    rows.append((path, data.get("LevelName"), data.get("Version", {}).get("Name"), None))
                except BROKEN as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "name", "version", "error"])

    return contents.select("path", "content").mapInPandas(read, "path string, name string, version string, error string")


def state(name: str) -> tuple[str, dict[str, str]]:
    """A block's name and properties: `name[key=value,...]`."""
    plain, _, rest = name.partition("[")
    return plain, {k.strip(): v.strip() for k, _, v in (p.partition("=") for p in rest.rstrip("]").split(",")) if v}


def varints(raw: bytes) -> np.ndarray:
    """Numbers in groups of seven bits, low groups first; a byte's high bit says that the number goes on.

    Bytes without the high bit end numbers, so a byte's place since the last end is its group. What follows the last end is
    no number.
    """
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    b = b[: ends[-1] + 1]
    group = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127) << (7 * np.minimum(group, 8)), starts)


def bit_packed(words, bits: int, count: int) -> np.ndarray:
    """count numbers of so many bits each, from the lowest bit of the first word on; numbers may lie across two words.

    Numbers beyond the last word are zero.
    """
    held = np.zeros(-(-count * bits // 64) + 2, dtype=np.uint64)
    given = np.array([int(w) & 0xFFFFFFFFFFFFFFFF for w in words], dtype=np.uint64)[: len(held)]
    held[: len(given)] = given
    first = np.arange(count, dtype=np.int64) * bits
    word, offset = first >> 6, (first & 63).astype(np.uint64)
    low = held[word] >> offset
    # a shift by 64 is not defined, so the next word moves in two steps
    high = (held[word + 1] << (np.uint64(63) - offset)) << np.uint64(1)
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.int64)


def varint_lists(raw: Column) -> Column:
    """varints() of a binary column; null stays null."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else varints(b))

    return read(raw)


def bit_lists(words: Column, bits: int, count: int) -> Column:
    """bit_packed() of a column of arrays of longs; null stays null."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda w: None if w is None else bit_packed(w, bits, count))

    return unpack(words)


def states(names: Column) -> Column:
    """state() of a column of names, a struct of name and props; null stays null."""

    @F.pandas_udf(T.StructType().add("name", T.StringType()).add("props", T.MapType(T.StringType(), T.StringType())))
    def parsed(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if n is None else state(n) for n in values], columns=["name", "props"], dtype=object)

    return parsed(names)


#: What a template leaves out: fixed values, by the end of a name or the whole name.
AIR, VOID = ":air", "minecraft:structure_void"


def _placed(numbers: np.ndarray, width: int, height: int, length: int, names: dict[int, tuple[str, dict]]):
    """Blocks by place, x first, then z, then y; numbers beyond the volume and numbers without a name are left out."""
    numbers = numbers[: width * height * length]
    known = [k for k, (name, _) in names.items() if not name.endswith(AIR) and name != VOID]
    at = np.flatnonzero(np.isin(numbers, known))
    return [(int(k % width), int(k // (width * length)), int(k // width % length), *names[int(numbers[k])]) for k in at]


def _structure(root: dict):
    palette = [(p["Name"], p.get("Properties", {})) for p in root["palette"]]
    return [(*b["pos"], *palette[b["state"]]) for b in root["blocks"]]


def _sponge(root: dict):
    root = root.get("Schematic", root)
    blocks = root.get("Blocks", root)
    names = {int(v): state(k) for k, v in blocks["Palette"].items()}
    data = blocks["Data"] if "Data" in blocks else blocks["BlockData"]
    return _placed(varints(bytes(b & 255 for b in data)), root["Width"], root["Height"], root["Length"], names)


def _litematic(root: dict):
    out = []
    for region in root["Regions"].values():
        names = {k: (p["Name"], p.get("Properties", {})) for k, p in enumerate(region["BlockStatePalette"])}
        w, h, n = (abs(region["Size"][c]) for c in "xyz")
        bits = max(2, (len(names) - 1).bit_length())
        out += _placed(bit_packed(region["BlockStates"], bits, w * h * n), w, h, n, names)
    return out


#: What a content that doesn't decode may raise.
BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, struct.error, OSError, EOFError, zlib.error, zipfile.BadZipFile, RecursionError, OverflowError)


def templates(contents: DataFrame) -> DataFrame:
    """(path, x, y, z, name, props, error) of the blocks, air and voids excepted, of structure, sponge and litematic files,
    told by content. A file that doesn't decode, or is null, is one row with its error."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, raw in zip(part["path"], part["content"], strict=True):
                try:
                    root = tags(raw)
                    blocks = _litematic(root) if "Regions" in root else _structure(root) if "blocks" in root else _sponge(root)
                    rows = [(path, x, y, z, name, {k: str(v) for k, v in props.items()}, None) for x, y, z, name, props in blocks if not name.endswith(AIR) and name != VOID]
                except BROKEN as e:
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                # a file at a time: a template may be large
                yield pd.DataFrame(rows, columns=["path", "x", "y", "z", "name", "props", "error"]).astype({c: "Int32" for c in "xyz"})

    return contents.select("path", "content").mapInPandas(read, "path string, x int, y int, z int, name string, props map<string,string>, error string")


def archives(contents: DataFrame, prefix: str, suffix: str, depth: int) -> DataFrame:
    """(path, entry, content, error) of an archive's entries with this prefix, suffix and number of slashes; what doesn't
    open is a row with its error."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, raw in zip(part["path"], part["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for n in z.namelist():
                            if n.startswith(prefix) and n.endswith(suffix) and n.count("/") == depth:
                                rows.append((path, n, z.read(n), None))
                except BROKEN as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["path", "entry", "content", "error"])

    return contents.select("path", "content").mapInPandas(read, "path string, entry string, content binary, error string")


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(raw):
        (size,) = struct.unpack_from(">I", raw, at)
        yield raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(mode: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line's bytes from their differences: to the left pixel (1), the line above (2), their mean (3) or the nearest of
    left, above and corner to left + above - corner (4)."""
    if mode == 0:
        return line
    if mode == 2:
        return line + above
    if mode == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out, up = line.tolist(), above.tolist()
    if mode == 3:
        for k in range(len(out)):
            out[k] = (out[k] + ((out[k - step] if k >= step else 0) + up[k]) // 2) & 255
    elif mode == 4:
        for k in range(len(out)):
            a, b, c = (out[k - step], up[k], up[k - step]) if k >= step else (0, up[k], 0)
            left, over, corner = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[k] = (out[k] + (a if left <= over and left <= corner else b if over <= corner else c)) & 255
    else:
        raise ValueError(f"no such filter: {mode}")
    return np.array(out, dtype=np.uint8)


def _png_lines(raw: bytes) -> Iterator[np.ndarray]:
    """The lines of a grey raster, one at a time, unpacked as they are needed."""
    if raw[:8] != PNG:
        raise ValueError("no raster")
    head = next((struct.unpack(">IIBBBBB", body) for kind, body in _chunks(raw) if kind == b"IHDR"), None)
    if head is None or head[3] != 0 or head[2] not in (8, 16) or head[6]:
        raise ValueError("only plain grey rasters")
    width, height, step = head[0], head[1], head[2] // 8
    stride, above, unpack, left = width * step, np.zeros(width * step, dtype=np.uint8), zlib.decompressobj(), b""
    done, bodies = 0, (body for kind, body in _chunks(raw) if kind == b"IDAT")
    more: bytes | None = b""
    while done < height and more is not None:
        left += unpack.decompress(more, 64 * (stride + 1)) if more else b""
        more = unpack.unconsumed_tail or next(bodies, None)
        left += unpack.flush() if more is None else b""
        lines = min(len(left) // (stride + 1), height - done)
        for k in range(lines):
            line = np.frombuffer(left, dtype=np.uint8, count=stride, offset=k * (stride + 1) + 1)
            above = _unfiltered(left[k * (stride + 1)], line, above, step)
            yield above.view(">u2").astype(np.int32) if step == 2 else above.astype(np.int32)
        done, left = done + lines, left[lines * (stride + 1) :]
    if done < height:
        raise ValueError("the raster is cut off")


#: The first bytes of a raster file (fixed value).
PNG = b"\x89PNG\r\n\x1a\n"


def png16(contents: DataFrame) -> DataFrame:
    """(path, x, z, px, error) of 8- and 16-bit grey PNG rasters; row is z, column is x. Lines are given out as they are
    read; a raster that doesn't decode ends with a row with its error."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, raw in zip(part["path"], part["content"], strict=True):
                try:
                    for z, line in enumerate(_png_lines(raw)):
                        yield pd.DataFrame({"path": path, "x": np.arange(len(line), dtype=np.int32), "z": np.int32(z), "px": line, "error": None})
                except BROKEN as e:
                    yield pd.DataFrame({"path": [path], "x": pd.array([None], "Int32"), "z": pd.array([None], "Int32"), "px": pd.array([None], "Int32"), "error": [f"{type(e).__name__}: {e}"]})

    return contents.select("path", "content").mapInPandas(read, "path string, x int, z int, px int, error string")


def array_bytes(arrays: dict[str, np.ndarray], compressed: bool = True) -> bytes:
    """An .npz file of named arrays; without compression and with one array only, an .npy file."""
    out = io.BytesIO()
    if compressed:
        np.savez_compressed(out, **arrays)
    else:
        (only,) = arrays.values()
        np.save(out, only)
    return out.getvalue()


def arrays(contents: DataFrame) -> DataFrame:
    """(path, name, x, z, value, error) of the cells of .npz and .npy files' arrays, told by content; the first axis is x, the
    second z. An array is given out a line of x at a time. Arrays of another number of axes, of objects, and what doesn't
    decode are rows with their error; an .npy file's array has no name."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, raw in zip(part["path"], part["content"], strict=True):
                try:
                    found = np.load(io.BytesIO(raw), allow_pickle=False)
                    for name in found.files if hasattr(found, "files") else [None]:
                        own = found if name is None else found[name]
                        if own.ndim != 2:
                            raise ValueError(f"{name}: {own.ndim} axes")
                        for x, line in enumerate(own):
                            yield pd.DataFrame({"path": path, "name": name, "x": np.int32(x), "z": np.arange(len(line), dtype=np.int32), "value": line.astype(np.float64), "error": None})
                except BROKEN as e:
                    none = pd.array([None], "Int32")
                    yield pd.DataFrame({"path": [path], "name": None, "x": none, "z": none, "value": [np.nan], "error": [f"{type(e).__name__}: {e}"]})

    return contents.select("path", "content").mapInPandas(read, "path string, name string, x int, z int, value double, error string")


def png_bytes(px: np.ndarray) -> bytes:
    """A PNG file of an array: two dimensions of 16-bit grey, or three with red, green and blue of 8 bits; lines are stored
    as differences to the line above."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    grey = px.ndim == 2
    lines = np.ascontiguousarray(px.astype(">u2" if grey else np.uint8)).view(np.uint8).reshape(px.shape[0], -1)
    lines = np.diff(lines, axis=0, prepend=np.zeros((1, lines.shape[1]), dtype=np.uint8)).astype(np.uint8)
    body = np.column_stack([np.full(len(lines), 2, dtype=np.uint8), lines]).tobytes()
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 16 if grey else 8, 0 if grey else 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def rasters(cells: DataFrame, layers: list[str], tile: int, name: str = "hm") -> DataFrame:
    """(path, content) of a PNG file a tile of cells: one layer is 16-bit grey, three are red, green and blue.

    A tile is at most tile x tile cells, whatever the grid's size; cells that are missing are 0.
    """
    placed = cells.select("x", "z", *layers, *[(F.floor(F.col(c) / tile) * tile).cast("int").alias(f"{c}0") for c in ("x", "z")])

    def draw(key, part: pd.DataFrame) -> pd.DataFrame:
        x, z = part["x"].to_numpy() - key[0], part["z"].to_numpy() - key[1]
        out = np.zeros((z.max() + 1, x.max() + 1, len(layers)), dtype=np.int64)
        out[z, x] = part[layers].to_numpy()
        return pd.DataFrame({"path": [f"{name}_x{key[0]}_z{key[1]}.png"], "content": [png_bytes(out[:, :, 0] if len(layers) == 1 else out)]})

    return placed.groupBy("x0", "z0").applyInPandas(draw, "path string, content binary")


def fingerprint(contents: DataFrame, version: str) -> DataFrame:
    """One row: a digest of a version and of all files; it changes with any name or content, not with their order.

    Files' digests are added as four 64-bit numbers each, so that sums combine before they move and nothing is gathered.
    """
    own = F.sha2(F.concat_ws(":", F.substring_index("path", "/", -1), F.sha2("content", 256)), 256)
    parts = [F.sum(F.conv(F.substring(own, 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    sums = contents.agg(F.count("*").alias("n"), *parts)
    words = [F.coalesce(F.col(f"p{k}"), F.lit(0)).cast("string") for k in range(4)]
    return sums.select(F.sha2(F.concat_ws("\n", F.lit(version), F.col("n").cast("string"), *words), 256).alias("fingerprint"))

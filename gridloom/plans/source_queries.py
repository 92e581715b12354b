"""Queries on decoders, names and states: binary containers are made in the query, from the tables, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.fixture import cells, sql
from gridloom.plans.registry import query
from gridloom.sources import binary

# fixed values: folder of a template, and the kind it stands for (none: left out), the more special ones first
FOLDER_KIND = [("paleoaktrees", None), ("darkoaktrees", "oak"), ("sprucetrees", "spruce"), ("oaktrees", "oak"), ("birchtrees", "birch"), ("azaleatrees", "azalea"), ("mushrooms", "mushroom")]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template paths made of part names."""
    folder = F.element_at(F.array(*map(F.lit, ["Lunas_Spruce Trees", "Dark Oak Trees", "PaleOakTrees", "Oak Trees", "Birch Trees", "other", "Snowy/Azalea Trees"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    size = F.element_at(F.array(*map(F.lit, ["Big_", "Small_", "Large_", "", "Snowy_"])), (F.col("p_size") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("packs/"), folder, F.lit("/"), size, F.lit("T"), F.col("p_partkey") % 50, F.when(F.col("p_partkey") % 3 == 0, ".schem").otherwise(".nbt")).alias("path"))


_PATHS_SQL = """paths as (select p_partkey, concat('packs/', (['Lunas_Spruce Trees', 'Dark Oak Trees', 'PaleOakTrees', 'Oak Trees', 'Birch Trees', 'other', 'Snowy/Azalea Trees'])[p_partkey % 7 + 1], '/',
  (['Big_', 'Small_', 'Large_', '', 'Snowy_'])[p_size % 5 + 1], 'T', p_partkey % 50, case when p_partkey % 3 = 0 then '.schem' else '.nbt' end) as path from part)"""
_KINDS = "case " + " ".join(f"when contains({{p}}, '{f}') then {repr(k) if k else 'null'}" for f, k in FOLDER_KIND) + " end"


def classified(paths: DataFrame) -> DataFrame:
    """kind, size and snowy by the path's parts: the first part that a folder is found in decides, in the folders' order."""
    parts = F.transform(F.split(F.lower("path"), "/"), lambda p: F.replace(F.replace(p, F.lit("lunas_"), F.lit("")), F.lit(" "), F.lit("")))
    known = F.filter(parts, lambda p: F.exists(F.array(*[F.lit(f) for f, _ in FOLDER_KIND]), lambda f: F.contains(p, f)))
    first = F.try_element_at(known, F.lit(1))
    kind = F.lit(None).cast("string")
    for folder, name in reversed(FOLDER_KIND):
        kind = F.when(F.contains(first, F.lit(folder)), F.lit(name)).otherwise(kind)
    base = F.substring_index(F.lower("path"), "/", -1)
    size = F.when(F.contains(base, F.lit("small")), "small").when(F.contains(base, F.lit("big")) | F.contains(base, F.lit("large")), "big").otherwise("normal")
    return paths.withColumns({"kind": kind, "size": size, "snowy": F.contains(F.lower("path"), F.lit("snow"))})


_CLASSES_SQL = f"""{_PATHS_SQL}, classes as (select p_partkey, path, {_KINDS.format(p="replace(replace(lower(path), 'lunas_', ''), ' ', '')")} as kind,
  case when contains(lower(split_part(path, '/', -1)), 'small') then 'small' when contains(lower(split_part(path, '/', -1)), 'big') or contains(lower(split_part(path, '/', -1)), 'large') then 'big' else 'normal' end as size,
  contains(lower(path), 'snow') as snowy from paths)"""


@query("path_classify", f"with {_CLASSES_SQL} select * from classes")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(_paths(spark, sf_dir))


@query("dedupe_priority", f"""with {_CLASSES_SQL} select kind, stem, snowy, p_partkey, path from (
  select *, regexp_replace(split_part(path, '/', -1), '\\.[a-z]+$', '') as stem,
  row_number() over (partition by kind, regexp_replace(split_part(path, '/', -1), '\\.[a-z]+$', ''), snowy order by case when path like '%.schem' then 0 else 1 end, p_partkey) as k from classes where kind is not null) where k = 1""")
def dedupe_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each kind, stem and snow; schematics before others. A minimum, so it combines before it moves."""
    rows = classified(_paths(spark, sf_dir)).where("kind is not null")
    rows = rows.withColumn("stem", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[a-z]+$", ""))
    order = F.struct(F.when(F.col("path").endswith(".schem"), 0).otherwise(1).alias("k"), F.col("p_partkey"), F.col("path"))
    return rows.groupBy("kind", "stem", "snowy").agg(F.min(order).alias("m")).select("kind", "stem", "snowy", "m.p_partkey", "m.path")


@query("block_state_parse", """select p_partkey, lower(p_brand) as name, concat('axis=', ['x','y','z'][p_partkey % 3 + 1], case when p_size > 25 then concat(', level=', p_size) else '' end) as raw,
  ['x','y','z'][p_partkey % 3 + 1] as axis, case when p_size > 25 then cast(p_size as varchar) end as level from part""")
def block_state_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the form `name[key=value, ...]`."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    axis = F.element_at(F.array(*map(F.lit, "xyz")), (F.col("p_partkey") % 3 + 1).cast("int"))
    props = F.concat(F.lit("axis="), axis, F.when(F.col("p_size") > 25, F.concat(F.lit(", level="), F.col("p_size"))).otherwise(""))
    named = part.select("p_partkey", props.alias("raw"), binary.states(F.concat(F.lower("p_brand"), F.lit("["), props, F.lit("]"))).alias("s"))
    return named.select("p_partkey", "s.name", "raw", F.try_element_at("s.props", F.lit("axis")).alias("axis"), F.try_element_at("s.props", F.lit("level")).alias("level"))


@query("varint_decode", "select o_orderkey, o_orderkey * 37 % 70000 as value from orders")
def varint_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a number in groups of seven bits, the last without the high bit, and reads it back."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 37 % 70000).alias("v"))
    byte = "lpad(hex({}), 2, '0')".format
    groups = f"concat(if(v > 127, {byte('(v & 127) | 128')}, {byte('v')}), if(v > 16383, {byte('(shiftright(v, 7) & 127) | 128')}, if(v > 127, {byte('shiftright(v, 7)')}, '')), if(v > 16383, {byte('shiftright(v, 14)')}, ''))"
    read = binary.varint_lists(F.expr(f"unhex({groups})"))
    return orders.select("o_orderkey", F.element_at(read, 1).alias("value"))


@query("bit_unpack", "select o_orderkey, unnest(range(12)) as k, (o_orderkey * 7 + unnest(range(12)) * 5) % 32 as value from orders")
def bit_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve five-bit numbers, after a lead of twenty bits, lie in two 64-bit words without gaps; the ninth lies across both."""
    value = "cast((o_orderkey * 7 + {k} * 5) % 32 as bigint)"
    low = " | ".join(f"shiftleft({value.format(k=k)}, {20 + 5 * k})" for k in range(9))
    high = " | ".join([f"shiftrightunsigned({value.format(k=8)}, 4)", *(f"shiftleft({value.format(k=k)}, {5 * k - 44})" for k in range(9, 12))])
    packed = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(f"array({low}, {high})").alias("words"))
    numbers = F.slice(binary.bit_lists(F.col("words"), 5, 16), 5, 12)
    return packed.select("o_orderkey", F.posexplode(numbers).alias("k", "value")).select("o_orderkey", F.col("k").cast("long").alias("k"), "value")


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region files of the orders: one a customer's remainder, a slot an order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 4).alias("f"), (F.col("o_orderkey") % 1024).cast("int").alias("slot"), F.col("o_orderpriority").alias("p"))
    one = orders.groupBy("f", "slot").agg(F.min("p").alias("p"))

    def pack(part):
        import pandas as pd

        slots = [(int(s), 1000 + int(s), p.encode()) for s, p in zip(part["slot"], part["p"], strict=True)]
        return pd.DataFrame({"path": [f"r.{part['f'].iloc[0]}.mca"], "content": [binary.region_bytes(slots)]})

    return one.groupBy("f").applyInPandas(pack, "path string, content binary")


_SLOTS_SQL = "slots as (select concat('r.', o_custkey % 4, '.mca') as path, cast(o_orderkey % 1024 as int) as slot, min(o_orderpriority) as text from orders group by 1, 2)"


def _text():
    return F.decode("payload", "UTF-8")


def _urgent():
    return _text().startswith("1") | _text().startswith("2")


@query("region_scan", f"with {_SLOTS_SQL} select path, slot, cast(slot % 32 as int) as cx, cast(slot // 32 as int) as cz, cast(1000 + slot as bigint) as timestamp, text from slots")
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.regions(_containers(spark, sf_dir)).select("path", "slot", "cx", "cz", "timestamp", _text().alias("text"))


@query("region_point", f"with {_SLOTS_SQL} select path, slot, text from slots where slot = 37")
def region_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk at (-27, 33) of every region file."""
    return binary.chunk_at(_containers(spark, sf_dir), -27, 33).select("path", "slot", _text().alias("text"))


@query("region_compact", f"with {_SLOTS_SQL} select path, slot, text from slots where text like '1%' or text like '2%'")
def region_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of the first two priorities, of files that hold nothing else any more."""
    kept = binary.compacted(binary.regions(_containers(spark, sf_dir)), _urgent())
    return binary.regions(kept).select("path", "slot", _text().alias("text"))


@query("rewrite_counts", f"with {_SLOTS_SQL} select path, count(*) filter (text like '1%' or text like '2%') as kept, count(*) filter (not (text like '1%' or text like '2%')) as dropped, count(*) filter (text like '1%' or text like '2%') = 0 as removed from slots group by path")
def rewrite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rewrite of region_compact keeps and drops of each file."""
    return binary.rewrite_counts(binary.regions(_containers(spark, sf_dir)), _urgent())


@query("content_fingerprint", "with own as (select sha256(concat('o', o_orderkey, ':', sha256(o_orderpriority))) as h from orders) select sha256(concat('v1', chr(10), count(*), chr(10), "
  + ", chr(10), ".join(f"cast(sum(cast(concat('0x', substr(h, {16 * k + 1}, 16)) as ubigint)) as varchar)" for k in range(4)) + ")) as fingerprint from own")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file an order, its priority the content."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return binary.fingerprint(orders.select(F.concat(F.lit("packs/o"), F.col("o_orderkey")).alias("path"), F.col("o_orderpriority").cast("binary").alias("content")), "v1")


@query("name_filter", "select p_partkey, p_type from part where (contains(p_type, 'A') or contains(p_type, 'S')) and not contains(p_type, 'ECONOMY')")
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.where(F.col("p_type").rlike("A|S") & ~F.col("p_type").contains("ECONOMY")).select("p_partkey", "p_type")


# ---- templates, archives, rasters and worlds, written in the query and read back -------------------------------------------
_STATES = ["minecraft:air", "minecraft:stone", "minecraft:oak_log[axis=y]", "minecraft:structure_void", "minecraft:dirt"]


def _template_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 parts a file, sponge and litematic in turn: blocks by p_size, some of states that the palette lacks, some beyond
    the volume."""

    def pack(part):
        import numpy as np
        import pandas as pd

        part = part.sort_values("p_partkey")
        f, numbers = int(part["f"].iloc[0]), (part["p_size"].to_numpy() % 6).astype(np.int64)
        height = len(numbers) // 20
        if f % 2 == 0:
            data = b"".join(bytes([v & 127 | 128, v >> 7]) if v > 127 else bytes([v]) for v in (40 * numbers).tolist())
            root = {"Schematic": {"Width": 5, "Height": height, "Length": 4, "Blocks": {"Palette": {name: 40 * k for k, name in enumerate(_STATES)}, "Data": data}}}
        else:
            whole = sum(v << (3 * k) for k, v in enumerate(numbers.tolist()))
            words = np.array([(whole >> (64 * k)) & (2**64 - 1) for k in range(-(-3 * len(numbers) // 64))], dtype=np.uint64).astype(np.int64)
            palette = [{"Name": n, "Properties": p} if p else {"Name": n} for n, p in map(binary.state, _STATES)]
            root = {"Regions": {"a": {"Size": {"x": -5, "y": height, "z": 4}, "BlockStatePalette": palette, "BlockStates": words}}}
        return pd.DataFrame({"path": [f"t{f}"], "content": [binary.tag_bytes(root)]})

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.expr("p_partkey div 200").alias("f"))
    return part.groupBy("f").applyInPandas(pack, "path string, content binary")


@query("template_scan", """with placed as (select p_partkey // 200 as f, p_size % 6 as s, row_number() over (partition by p_partkey // 200 order by p_partkey) - 1 as k, count(*) over (partition by p_partkey // 200) as m from part)
  select concat('t', f) as path, cast(k % 5 as int) as x, cast(k // 20 as int) as y, cast(k // 5 % 4 as int) as z, case s when 1 then 'minecraft:stone' when 2 then 'minecraft:oak_log' else 'minecraft:dirt' end as name,
  case when s = 2 then 'y' end as axis from placed where k < m // 20 * 20 and s in (1, 2, 4)""")
def template_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary.templates(_template_files(spark, sf_dir)).where("error is null")
    return found.select("path", "x", "y", "z", "name", F.try_element_at("props", F.lit("axis")).alias("axis"))


@query("archive_scan", "select concat('a', p_partkey // 100) as path, concat('data/packs/p', p_partkey, '.txt') as entry, p_name as text from part where p_partkey % 3 = 0 union all select 'broken', null, null")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 parts an archive; entries of the wanted folder and suffix, and a row for an archive that doesn't open."""

    def pack(part):
        import io
        import zipfile

        import pandas as pd

        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for key, name in zip(part["p_partkey"], part["p_name"], strict=True):
                z.writestr([f"data/packs/p{key}.txt", f"data/packs/deep/p{key}.txt", f"data/packs/p{key}.png"][key % 3], name)
        return pd.DataFrame({"path": [f"a{part['f'].iloc[0]}"], "content": [raw.getvalue()]})

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.expr("p_partkey div 100").alias("f"))
    made = part.groupBy("f").applyInPandas(pack, "path string, content binary")
    broken = spark.range(1).select(F.lit("broken").alias("path"), F.lit("no archive").cast("binary").alias("content"))
    return binary.archives(made.unionByName(broken), "data/packs/", ".txt", 2).select("path", "entry", F.decode("content", "UTF-8").alias("text"))


@query("png_scan", sql("select concat('hm_x', x // 20 * 20, '_z', z // 20 * 20, '.png') as path, cast(x % 20 as int) as x, cast(z % 20 as int) as z, hm as px from cells"))
def png_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heightmap as 16-bit files of 20 x 20 cells, read back."""
    files = binary.rasters(cells(spark, sf_dir), ["hm"], 20)
    return binary.png16(files).where("error is null").select("path", "x", "z", "px")


@query("array_scan", sql("select concat('tile_', x // 16, '_', z // 16, '.npz') as path, name, cast(x % 16 as int) as x, cast(z % 16 as int) as z, value from (select x, z, 'hm' as name, cast(hm as double) as value from cells union all select x, z, 'water', case when water then 1.0 else 0.0 end from cells)"))
def array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of the grid as compressed array files of 16 x 16 cells, read back."""

    def pack(key, part):
        import numpy as np
        import pandas as pd

        layers = {"hm": np.zeros((16, 16), dtype=np.uint16), "water": np.zeros((16, 16), dtype=bool)}
        for name, layer in layers.items():
            layer[part["x"] % 16, part["z"] % 16] = part[name]
        return pd.DataFrame({"path": [f"tile_{key[0]}_{key[1]}.npz"], "content": [binary.array_bytes(layers)]})

    tiles = cells(spark, sf_dir).select("x", "z", "hm", "water").groupBy(F.shiftright("x", 4), F.shiftright("z", 4))
    return binary.arrays(tiles.applyInPandas(pack, "path string, content binary")).where("error is null").select("path", "name", "x", "z", "value")


@query("world_scan", "select n_name as path, concat('world of ', n_name) as name, case when n_nationkey % 2 = 0 then cast(n_nationkey as varchar) end as version from nation")
def world_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata files of one world a nation, gzipped; some name no version."""

    def pack(parts):
        import gzip

        import pandas as pd

        for part in parts:
            roots = [{"Data": {"LevelName": f"world of {n}"} | ({"Version": {"Name": str(k)}} if k % 2 == 0 else {})} for k, n in zip(part["n_nationkey"], part["n_name"], strict=True)]
            yield pd.DataFrame({"path": part["n_name"], "content": [gzip.compress(binary.tag_bytes(r)) for r in roots]})

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return binary.world(nation.mapInPandas(pack, "path string, content binary")).select("path", "name", "version")

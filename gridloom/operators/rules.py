"""Rule ladders on cells, as SQL text: elevation and depth scaling, surface, snow, forest, lakebed, shore, plants, colours.

Names of layers are column names or expressions; noises come as a dictionary of them by name, for the layers listed here. Assignments that overwrite each other are cases with the last one first.
"""

from __future__ import annotations

from gridloom.functions.dialect import SPARK, Dialect, case, clip
from gridloom.functions.hashing import bhash
from gridloom.functions.noise import white_noise
from gridloom.functions.palette import BLOCKS, CODE, pick, uniform
from gridloom.operators.noise_layers import Smooth

# fixed values: landcover codes in the order of their priority
LANDCOVER = ["none", "grass", "farm", "forest", "scrub", "wetland", "scree", "rock", "glacier", "water"]
LC = {name: k for k, name in enumerate(LANDCOVER)}
# fixed values: metres
VALLEY, MONTANE, SUBALPINE, TREELINE, SNOW_PATCHY, SNOWLINE = 650, 900, 1450, 1750, 1950, 2350
# fixed values: degrees
SLOPE_SCREE, SLOPE_STEEP, SLOPE_CLIFF = 26, 33, 46
MAX_SNOW = 16
# fixed values: elevation from which a biome holds
BIOMES = [(2050, "jagged_peaks"), (1750, "snowy_slopes"), (1450, "grove"), (900, "old_growth_spruce_taiga"), (0, "meadow")]
# fixed values: heights of the volume, depth of water and the shelf's width, in blocks
Y_MIN, Y_MAX, FILL_BOTTOM, MAX_DEPTH, SHELF = -40, 300, -64, 30, 26
# fixed values: lakebed materials
LAKEBED = ["stream", "sand", "gravel", "clay", "mud", "stone", "cobble", "calcite"]
# fixed values: flowers of a patch
FLOWERS_LOW = ["oxeye_daisy", "cornflower", "poppy", "dandelion", "azure_bluet", "allium", "white_tulip", "orange_tulip"]
FLOWERS_ALPINE = ["oxeye_daisy", "azure_bluet", "dandelion", "cornflower"]


def dequantised_y(px: str, d: Dialect = SPARK) -> str:
    return f"cast({d.rint(f'{Y_MIN} + {px} / {d.num(65535.0)} * {Y_MAX - Y_MIN}')} as int)"


def dequantised_metres(px: str, low: str, high: str, d: Dialect = SPARK) -> str:
    return f"({low} + {px} / {d.num(65535.0)} * ({high} - {low}))"


def quantised(value: str, low: str, high: str, d: Dialect = SPARK) -> str:
    """16 bits; a flat raster, whose range is empty, is all zero."""
    scaled = clip(d.rint(f"({value} - {low}) / nullif({high} - {low}, 0) * 65535"), 0, 65535)
    return f"cast(coalesce({scaled}, 0) as int)"


def depth_curve(distance: str, water: str, d: Dialect = SPARK) -> str:
    """Blocks of water by the distance to the shore."""
    deep = d.rint(f"{MAX_DEPTH} * (1 - exp(-({distance}) / {d.num(float(SHELF))}))")
    return f"cast(case when {water} then greatest(1, {deep}) else 0 end as int)"


def biome(elev: str) -> str:
    return case([(f"{elev} >= {at}", f"'{name}'") for at, name in BIOMES], f"'{BIOMES[-1][1]}'")


def derived_landcover(landcover: str, water: str) -> str:
    """The water mask over the landcover: eroded water turns to wetland."""
    return case([(water, str(LC["water"])), (f"{landcover} = {LC['water']}", str(LC["wetland"]))], landcover)


def field_noise(seed: int = 1234) -> dict[str, Smooth]:
    """The noises below the surface ladder's layers."""
    return {
        "n_big": Smooth(440, seed, 3), "n_mid": Smooth(104, seed + 1, 3), "clump": Smooth(20, seed + 3, 2), "grain": Smooth(16, seed + 910, 2),
        "n_snow": Smooth(34, seed + 4001, 2), "open": Smooth(60, seed + 5001, 3),
    }


def fields(noise: dict[str, str], x: str, z: str, seed: int = 1234, d: Dialect = SPARK) -> dict[str, str]:
    """The layers that the surface ladder reads, from those of field_noise()."""
    return {
        "n_big": noise["n_big"],
        "n_mid": noise["n_mid"],
        "r": clip(f"{d.num(0.28)} * {white_noise(x, z, seed + 2, d)} + {d.num(0.72)} * ({noise['clump']} * 0.5 + 0.5)", "0", d.num(0.999)),
        "rb": clip(f"{d.num(0.35)} * {white_noise(x, z, seed + 909, d)} + {d.num(0.65)} * ({noise['grain']} * 0.5 + 0.5)", "0", d.num(0.999)),
        "n_snow": noise["n_snow"],
        "glade": clip(f"({noise['open']} - {d.num(0.18)}) * {d.num(2.4)}", 0, 1),
    }


def surface(elev: str = "elev", landcover: str = "landcover", slope: str = "slope", north: str = "north", curv: str = "curv", d: Dialect = SPARK, names: bool = False) -> str:
    """The surface block (code, or key if names): reads the layers of fields(), too."""
    shift = f"(n_big * 120 - {north} * 85)"
    tree = f"({TREELINE} + {shift})"
    steepness = f"({slope} - {curv} * 7)"
    is_ = lambda name: f"{landcover} = {LC[name]}"
    rock = f"({steepness} > {SLOPE_CLIFF} + n_mid * 4 or {is_('rock')})"
    floor = f"(rb < {forest_cover(elev, landcover, slope, tree, d)})"
    damp = f"({clip(f'{d.num(0.45)} + {d.num(0.3)} * {north} + {d.num(0.35)} * {curv} + {d.num(0.2)} * n_big', 0, 1)} > {d.num(0.62)})"
    zone = lambda name: pick("r", name, d, names)
    fixed = lambda key: f"'{key}'" if names else str(CODE[key])
    return case(
        [
            (is_("water"), fixed("water")),
            (is_("glacier"), fixed("ice")),
            (f"{rock} and {elev} < {MONTANE}", zone("rock_low")),
            (f"{rock} and {elev} < {SUBALPINE}", zone("rock_mid")),
            (rock, zone("rock_high")),
            (f"{steepness} > {SLOPE_STEEP} + n_mid * 5", zone("rock_mid")),
            (f"{slope} > {SLOPE_SCREE} and {curv} > 0.25 and {elev} > {MONTANE}", zone("scree")),
            (is_("scree"), zone("scree")),
            (f"{floor} and {damp}", zone("floor_damp")),
            (f"{floor} and {elev} > {MONTANE}", zone("floor_conifer")),
            (floor, zone("floor_broad")),
            (is_("wetland"), zone("wetland")),
            (is_("farm"), zone("farm")),
            (f"{elev} > {tree} + 250", zone("barren")),
            (f"{elev} > {tree}", zone("alpine")),
            (f"{elev} > {MONTANE}", zone("montane")),
        ],
        zone("meadow"),
    )


def forest_cover(elev: str, landcover: str, slope: str, tree: str, d: Dialect = SPARK) -> str:
    """How likely a cell is wooded, before glades, soil and snow."""
    wooded = f"case when {landcover} = {LC['forest']} then 1 else 0 end"
    below, flat = clip(f"({tree} - {elev}) / {d.num(220.0)}", 0, 1), clip(f"(46 - {slope}) / {d.num(14.0)}", 0, 1)
    return f"({wooded}) * {below} * {flat} * {clip(f'{d.num(0.75)} + {d.num(0.45)} * (n_mid * 0.5 + 0.5)', 0, 1)}"


#: Surfaces in which trees root.
SOIL = ["grass", "moss", "podzol", "dirt", "coarse", "rooted"]


def forest_probability(elev: str, landcover: str, slope: str, north: str, surface_key: str, snow: str, d: Dialect = SPARK) -> str:
    tree = f"({TREELINE} + (n_big * 120 - {north} * 85))"
    soil = f"case when {surface_key} in ({', '.join(repr(k) for k in SOIL)}) then 1 else 0 end"
    return f"({forest_cover(elev, landcover, slope, tree, d)} * (1 - {d.num(0.85)} * glade) * ({soil}) * {clip(f'(8 - {snow}) / {d.num(6.0)}', 0, 1)})"


def leaf(p: str, elev: str, r: str) -> str:
    wooded = f"{p} > 0.02"
    return case(
        [
            (f"not ({wooded})", "'none'"),
            (f"{elev} < {VALLEY + 200} and {r} < 0.06", "'azalea_leaf'"),
            (f"{elev} < {MONTANE} and {r} > 0.72", "'birch_leaf'"),
            (f"{elev} > {MONTANE} and {elev} < {SUBALPINE} and {r} > 0.86", "'birch_leaf'"),
            (f"{elev} > {MONTANE}", "'spruce_leaf'"),
        ],
        "'oak_leaf'",
    )


def snow_amount(elev: str, slope: str, north: str, d: Dialect = SPARK) -> str:
    """The greater of patchy and permanent snow."""
    n = d.num
    shift = f"(n_big * 120 - {north} * 85)"
    patchy = f"(({elev} - ({SNOW_PATCHY} + {shift} - 140)) / {n(240.0)} * ({n(0.72)} + {n(0.28)} * {clip(north, -1, 1)}) * (1 - {clip(f'({slope} - 40) / {n(35.0)}', 0, n(0.85))}) + {n(0.14)} * n_snow)"
    settling = clip(f"(72 - {slope}) / {n(32.0)}", n(0.15), 1)
    permanent = f"((1 + ({elev} - ({SNOWLINE} + {shift} * {n(0.6)})) / {n(320.0)}) * ({n(0.65)} + {n(0.35)} * {settling}))"
    return f"greatest({patchy}, {permanent})"


def snow_units(amount: str, d: Dialect = SPARK) -> str:
    """Eighths of a block, before the limiter."""
    return f"case when {amount} > {d.num(0.03)} then cast({clip(f'ceil(({amount} - {d.num(0.03)}) * 8)', 1, MAX_SNOW)} as int) else 0 end"


def snow_phase(units: str, offset: str) -> str:
    """Units moved by the terrain's rounding remainder; half is rounded up."""
    moved = clip(f"{units} + cast(floor({offset} * 8 + 0.5) as int)", 1, MAX_SNOW + 4)
    return f"case when {units} > 0 then {moved} else {units} end"


def relief_noise(seed: int = 8128) -> dict[str, Smooth]:
    """The noises of the lakebed's relief."""
    return {"basin": Smooth(180, seed, 3), "dent": Smooth(58, seed + 101, 2), "ridge": Smooth(92, seed + 211, 2), "cliff": Smooth(138, seed + 307, 2)}


def underwater_relief(depth: str, water: str, noise: dict[str, str], d: Dialect = SPARK) -> str:
    """Basins, ridges and cliffs on the lakebed; the shelf of one and two blocks stays. Reads relief_noise()."""
    n = d.num
    broad, medium, ridge, cliff = (noise[k] for k in ("basin", "dent", "ridge", "cliff"))
    inner = clip(f"({depth} - 2) / {n(12.0)}", 0, 1)
    basins = f"({n(2.8)} * {broad} + {n(1.6)} * {medium} - 3 * {clip(f'1 - abs({ridge}) / {n(0.16)}', 0, 1)}) * {inner}"
    steps = f"(case when {cliff} > {n(0.24)} then 3 when {cliff} < {n(-0.38)} then -2 else 0 end) * {clip(f'({depth} - 7) / {n(8.0)}', 0, 1)}"
    changed = clip(d.rint(f"{depth} + {basins} + {steps}"), 1, MAX_DEPTH)
    return f"cast(case when not {water} or {depth} <= 2 then {depth} else {changed} end as int)"


def edge_noise(seed: int = 9321) -> dict[str, Smooth]:
    """The noises of lake edges."""
    return {"bay": Smooth(18, seed, 2), "nick": Smooth(6, seed + 71, 2)}


def naturalise_score(noise: dict[str, str], d: Dialect = SPARK) -> str:
    return f"({d.num(0.78)} * {noise['bay']} + {d.num(0.22)} * {noise['nick']})"


#: The noises of the lakebed's materials, and those of its plants.
LAKEBED_NOISE = {"broad": Smooth(84, 7611, 3), "medium": Smooth(42, 7682, 2)}
HABITAT_NOISE = {"meadow": Smooth(52, 8841, 3), "tuft": Smooth(23, 8912, 2)}


def _bands(value: str, bands: list[tuple[float, str]], last: str) -> str:
    return case([(f"{value} < {upto}", f"'{name}'") for upto, name in bands], f"'{last}'")


def lakebed(depth: str, relief: str, lake: str, d: Dialect = SPARK) -> str:
    """Reads the layers of LAKEBED_NOISE, too."""
    n = d.num
    half = lambda f: f"({f} * 0.5 + 0.5)"
    texture = clip(f"{n(0.74)} * {half('broad')} + {n(0.26)} * {half('medium')}", 0, n(0.999))
    rough = clip(f"{n(0.7)} * {half('medium')} + {n(0.3)} * {half('broad')}", 0, n(0.999))
    deep = f"({depth} + broad * {n(2.4)} + medium * {n(0.8)})"
    return case(
        [
            (f"{depth} <= 0", "'clay'"),
            (f"not {lake}", "'stream'"),
            (f"{depth} >= 3 and {relief} >= 2", _bands(rough, [(0.36, "stone"), (0.70, "cobble")], "gravel")),
            (f"{deep} < 6", _bands(texture, [(0.46, "gravel"), (0.59, "cobble"), (0.70, "sand")], "clay")),
            (f"{deep} < 13", _bands(texture, [(0.42, "gravel"), (0.58, "clay"), (0.68, "sand"), (0.74, "cobble")], "mud")),
        ],
        _bands(texture, [(0.49, "mud"), (0.65, "clay"), (0.67, "calcite"), (0.73, "gravel")], "stone"),
    )


def habitat(noise: dict[str, str], d: Dialect = SPARK) -> str:
    """Reads HABITAT_NOISE."""
    half = lambda f: f"({f} * 0.5 + 0.5)"
    return clip(f"{d.num(0.78)} * {half(noise['meadow'])} + {d.num(0.22)} * {half(noise['tuft'])}", 0, 1)


#: The noises of decoration's layers.
DECOR_NOISE = {"wet": Smooth(70, 5150, 3), "open": Smooth(60, 5151, 3), "a": Smooth(14, 5152, 2), "b": Smooth(9, 5153, 2), "c": Smooth(24, 5154, 2)}


def decor_fields(noise: dict[str, str], d: Dialect = SPARK) -> dict[str, str]:
    """Damp ground, clearings and three patterns of patches, from DECOR_NOISE and the layers north and curv."""
    half = lambda f: f"({f} * 0.5 + 0.5)"
    return {
        "damp": clip(f"{d.num(0.45)} + {d.num(0.3)} * north + {d.num(0.35)} * curv + {d.num(0.2)} * {noise['wet']}", 0, 1),
        "clearing": clip(f"({noise['open']} - {d.num(0.18)}) * {d.num(2.4)}", 0, 1),
        "patch_a": half(noise["a"]),
        "patch_b": half(noise["b"]),
        "patch_c": half(noise["c"]),
    }


def aquatic_plant(depth: str, bed: str, relief: str, x: str, z: str, d: Dialect = SPARK) -> str:
    """'tall', 'short', 'lily' or 'none'; reads a layer habitat."""
    roll, tall = bhash(x, z, 8, d), bhash(x, z, 18, d)
    density = f"(case when habitat > 0.62 then {d.num(0.28)} when habitat > 0.54 then {d.num(0.11)} else 0 end)"
    grows = f"({depth} between 1 and 4 and {relief} <= 1 and {bed} in ('sand', 'gravel', 'clay') and {roll} < {density})"
    return case(
        [
            (f"{grows} and {depth} >= 2 and {tall} < 0.24", "'tall'"),
            (grows, "'short'"),
            (f"{depth} = 1 and {relief} = 0 and habitat > 0.70 and {roll} > 0.998", "'lily'"),
        ],
        "'none'",
    )


# fixed values: how likely a shore is beach, by steps to the water
SHORE_FALLOFF = {1: 0.92, 2: 0.62, 3: 0.32, 4: 0.12}


def shore_probability(steps: str, widest: str, d: Dialect = SPARK) -> str:
    near = case([(f"{steps} = {k}", d.num(v)) for k, v in SHORE_FALLOFF.items()], d.num(0.0))
    return f"({near} * {clip(f'({widest} - 2) / {d.num(6.0)}', 0, 1)})"


def shore_material(dry: str, shore: str, p: str, patch_a: str, patch_b: str, patch_c: str, damp: str, slope: str, x: str, z: str, d: Dialect = SPARK) -> str:
    """Beach of cobble, sand or gravel, wet mud or moss, or 'none'."""
    texture = clip(f"{d.num(0.68)} * {patch_a} + {d.num(0.32)} * {patch_b}", 0, 1)
    return case(
        [
            (f"not ({dry} and {shore})", "'none'"),
            (f"{texture} < {p} and {bhash(x, z, 9, d)} < 0.06", "'cobble'"),
            (f"{texture} < {p} and {patch_b} > 0.60", "'sand'"),
            (f"{texture} < {p}", "'gravel'"),
            (f"{damp} > 0.56 and {slope} < 22 and {patch_c} > 0.46 and {patch_b} < 0.70", "'mud'"),
            (f"{damp} > 0.56 and {slope} < 22 and {patch_c} > 0.46", "'moss'"),
        ],
        "'none'",
    )


# fixed values: what lies under soil, below and above the treeline
SUBSOIL_LOW, SUBSOIL_HIGH = ["dirt", "dirt", "dirt", "coarse_dirt"], ["coarse_dirt", "dirt", "gravel", "stone"]
# fixed values: what covers the bed of a stream
STREAM_BED = ["dirt", "coarse_dirt", "gravel", "moss_block", "dirt", "podzol", "gravel", "clay"]


def subsoil(layer: int, elev: str, x: str, z: str, d: Dialect = SPARK) -> str:
    r = bhash(x, z, 4 + layer, d)
    return f"case when {elev} > {TREELINE} then {uniform(r, SUBSOIL_HIGH, d)} else {uniform(r, SUBSOIL_LOW, d)} end"


def clamped_depth(y: str, requested: str, water: str) -> str:
    return f"case when {water} then least({requested}, greatest(0, {y} - {FILL_BOTTOM + 1})) else 0 end"


def _flower(patch: str, names: list[str], d: Dialect) -> str:
    at = f"({d.truncate(f'{patch} * {len(names)}')} % {len(names)})"
    return case([(f"{at} = {k}", f"'{v}'") for k, v in enumerate(names[:-1])], f"'{names[-1]}'")


def ground_cover(zone: str, r: str, a: str, b: str, c: str, damp: str, dense: str, elev: str, d: Dialect = SPARK) -> str:
    """The plant on a cell, or null. Plants of two blocks are tall_grass and large_fern."""
    n = d.num
    wet = case([(f"{r} < 0.55", "'short_grass'"), (f"{r} < 0.62", "'tall_grass'")])
    cover = f"({n(0.16)} + {n(0.30)} * {c})"
    alpine = case([
        (f"{r} > {cover}", "null"),
        (f"{a} > 0.72 and {r} < {cover} * {n(0.30)}", _flower(b, FLOWERS_ALPINE, d)),
        (f"{damp} > 0.62 and {r} < {cover} * {n(0.45)}", "'fern'"),
    ], "'short_grass'")
    cover = f"({n(0.30)} + {n(0.45)} * {c})"
    forest = case([
        (f"{r} > {cover}", "null"),
        (f"{dense} > 0.55 and {damp} > 0.66 and {r} < {cover} * {n(0.06)}", f"case when {b} > 0.5 then 'red_mushroom' else 'brown_mushroom' end"),
        (f"{damp} > 0.62 and {b} > 0.62 and {r} < {cover} * {n(0.30)}", "'moss_carpet'"),
        (f"{elev} > 900 and {a} > 0.78 and {r} < {cover} * {n(0.10)}", "'sweet_berry_bush'"),
        (f"{damp} > 0.55 and {a} > 0.55 and {r} < {cover} * {n(0.22)}", "'large_fern'"),
        (f"{damp} > 0.55 and {a} > 0.55", "'fern'"),
        (f"{dense} < 0.35 and {a} < 0.40 and {r} < {cover} * {n(0.30)}", "'tall_grass'"),
    ], "'short_grass'")
    cover = f"({n(0.38)} + {n(0.42)} * {c})"
    meadow = case([
        (f"{r} > {cover}", "null"),
        (f"{a} > 0.66 and {r} < {cover} * {n(0.32)}", _flower(b, FLOWERS_LOW, d)),
        (f"{a} < 0.30 and {r} < {cover} * {n(0.34)}", "'tall_grass'"),
        (f"{damp} > 0.68 and {r} < {cover} * {n(0.18)}", "'fern'"),
    ], "'short_grass'")
    return case([(f"{zone} = 'wetland'", wet), (f"{zone} = 'alpine'", alpine), (f"{zone} = 'forest'", forest)], meadow)


def colour(channel: int, surface_key: str, leaf_key: str, p: str, snow: str, d: Dialect = SPARK, shade: str = "1") -> str:
    """One channel (0 red, 1 green, 2 blue) of the leaves over the ground, the snow over both, and the light on all."""
    of = lambda key: case([(f"{key} = '{b[0]}'", d.num(float(b[2 + channel]))) for b in BLOCKS], of_water)
    of_water = d.num(float(BLOCKS[0][2 + channel]))
    w, s = clip(f"{p} * {d.num(1.15)}", 0, 1), f"({clip(f'{snow} / {d.num(8.0)}', 0, 1)} * {d.num(0.9)})"
    mixed = f"(({of(surface_key)}) * (1 - {w}) + ({of(leaf_key)}) * {w})"
    snowy = d.num(float(BLOCKS[CODE["snow_thin"]][2 + channel]))
    return f"cast(floor({clip(f'({mixed} * (1 - {s}) + {snowy} * {s}) * {shade}', 0, 255)}) as int)"


def utm_epsg(lon: str, lat: str, d: Dialect = SPARK) -> str:
    zone = f"({d.truncate(f'({lon} + 180) / {d.num(6.0)}')} + 1)"
    return f"case when {lat} >= 0 then 32600 + {zone} else 32700 + {zone} end"


# fixed values: metres by kind of waterway, and of any other
WIDTHS, WIDTH = {"river": 12, "canal": 8, "stream": 4, "ditch": 2, "drain": 2}, 4


def plantable(soil: str, mud: str, wet_shore: str, snow: str, water: str, ice: str, beach: str) -> str:
    """Where low plants may grow; all arguments are truths but snow, a number of layers."""
    return f"(({soil} or {mud} or {wet_shore}) and {snow} = 0 and not {water} and not {ice} and not {beach})"


def plant_zone(surface_key: str, wet_shore: str, forest: str, elev: str) -> str:
    """The zone whose plants a plantable cell gets; null where nothing grows."""
    return case(
        [
            (f"{surface_key} = 'mud' or {wet_shore}", "'wetland'"),
            (f"{forest} > 0.28", "'forest'"),
            (f"{elev} > {TREELINE}", "'alpine'"),
            (f"{surface_key} in ('grass', 'moss')", "'meadow'"),
        ],
        "null",
    )


# fixed values: the block that shows a lakebed material, and the colours of sand, plants under water and dry land
LAKEBED_BLOCK = {"stream": "moss", "gravel": "gravel", "clay": "clay", "mud": "mud", "stone": "stone", "cobble": "cobble", "calcite": "calcite"}
SAND, OVERLAY, DRY = (219, 207, 163), {"short": (66, 116, 52), "tall": (45, 139, 56), "lily": (83, 139, 55)}, (22, 27, 24)


def lakebed_colour(channel: int, bed: str, depth: str, plant: str, water: str, d: Dialect = SPARK) -> str:
    """One channel of a lakebed's picture: materials, darker with depth, plants over them, dry land dark."""
    n = lambda v: d.num(float(v))
    ground = case([(f"{bed} = 'sand'", n(SAND[channel])), *((f"{bed} = '{k}'", n(BLOCKS[CODE[b]][2 + channel])) for k, b in LAKEBED_BLOCK.items())], n(0))
    shaded = f"({ground} * (1 - {d.num(0.26)} * {clip(f'{depth} / {d.num(30.0)}', 0, 1)}))"
    shown = case([(f"not {water}", n(DRY[channel])), *((f"{plant} = '{k}'", n(v[channel])) for k, v in OVERLAY.items())], shaded)
    return f"cast(floor({clip(shown, 0, 255)}) as int)"


def relief_shade(gx: str, gz: str, d: Dialect = SPARK) -> str:
    """How much light a slope gets, 0.38 to 1.32; the sun stands north-west at 50 degrees."""
    steep, aspect = f"atan(sqrt({gx} * {gx} + {gz} * {gz}))", f"atan2(-({gx}), {gz})"
    light = f"(sin(radians(50.0)) * cos({steep}) + cos(radians(50.0)) * sin({steep}) * cos(radians(315.0) - {aspect}))"
    return clip(f"{d.num(0.58)} + {d.num(0.62)} * {light}", d.num(0.38), d.num(1.32))

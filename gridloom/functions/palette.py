"""Blocks, weighted palettes and categorical choice."""

from __future__ import annotations

from gridloom.functions.dialect import SPARK, Dialect, case

# fixed values: block key, block name, red, green, blue; a block's code is its place
BLOCKS = [
    ("water", "water", 60, 110, 200),
    ("ice", "packed_ice", 142, 180, 251),
    ("blue_ice", "blue_ice", 116, 168, 253),
    ("snow", "snow_block", 249, 254, 254),
    ("snow_thin", "snow", 249, 254, 254),
    ("calcite", "calcite", 224, 224, 221),
    ("diorite", "diorite", 189, 188, 189),
    ("clay", "clay", 161, 167, 179),
    ("smooth", "smooth_stone", 159, 159, 159),
    ("andesite", "andesite", 136, 136, 137),
    ("gravel", "gravel", 132, 128, 126),
    ("cobble", "cobblestone", 128, 127, 128),
    ("stone", "stone", 126, 126, 126),
    ("mossy_cob", "mossy_cobblestone", 110, 118, 95),
    ("dripstone", "dripstone_block", 134, 108, 92),
    ("pale_moss", "pale_moss_block", 107, 112, 105),
    ("tuff", "tuff", 108, 109, 103),
    ("deepslate", "deepslate", 80, 80, 83),
    ("cob_deep", "cobbled_deepslate", 77, 77, 81),
    ("basalt", "smooth_basalt", 73, 72, 78),
    ("rooted", "rooted_dirt", 144, 104, 76),
    ("dirt", "dirt", 134, 96, 67),
    ("coarse", "coarse_dirt", 119, 86, 59),
    ("podzol", "podzol", 91, 62, 31),
    ("moss", "moss_block", 89, 110, 45),
    ("mud", "mud", 60, 58, 61),
    ("grass", "grass_block", 110, 152, 74),
    ("spruce_leaf", "spruce_leaves", 58, 86, 54),
    ("oak_leaf", "oak_leaves", 72, 104, 50),
    ("birch_leaf", "birch_leaves", 98, 120, 62),
    ("azalea_leaf", "flowering_azalea_leaves", 92, 116, 58),
]
CODE = {b[0]: k for k, b in enumerate(BLOCKS)}

# fixed values: zone, then block key and weight
PALETTES = {
    "meadow": [("grass", 0.74), ("moss", 0.18), ("dirt", 0.05), ("coarse", 0.03)],
    "montane": [("grass", 0.55), ("moss", 0.30), ("podzol", 0.10), ("coarse", 0.05)],
    "floor_conifer": [("podzol", 0.40), ("coarse", 0.20), ("moss", 0.16), ("dirt", 0.10), ("rooted", 0.08), ("grass", 0.06)],
    "floor_damp": [("moss", 0.46), ("podzol", 0.18), ("grass", 0.16), ("dirt", 0.10), ("mud", 0.05), ("rooted", 0.05)],
    "floor_broad": [("grass", 0.34), ("dirt", 0.22), ("podzol", 0.18), ("moss", 0.14), ("rooted", 0.07), ("coarse", 0.05)],
    "alpine": [("grass", 0.48), ("moss", 0.24), ("pale_moss", 0.10), ("gravel", 0.10), ("coarse", 0.05), ("stone", 0.03)],
    "barren": [("gravel", 0.26), ("tuff", 0.22), ("stone", 0.16), ("pale_moss", 0.14), ("andesite", 0.12), ("coarse", 0.10)],
    "scree": [("gravel", 0.36), ("cobble", 0.22), ("tuff", 0.18), ("stone", 0.14), ("andesite", 0.10)],
    "rock_low": [("stone", 0.24), ("mossy_cob", 0.18), ("cob_deep", 0.16), ("andesite", 0.14), ("deepslate", 0.14), ("tuff", 0.14)],
    "rock_mid": [("stone", 0.26), ("andesite", 0.22), ("cobble", 0.16), ("tuff", 0.12), ("smooth", 0.10), ("gravel", 0.08), ("dripstone", 0.06)],
    "rock_high": [("calcite", 0.24), ("diorite", 0.20), ("clay", 0.08), ("smooth", 0.13), ("andesite", 0.13), ("gravel", 0.07), ("stone", 0.11), ("pale_moss", 0.04)],
    "wetland": [("mud", 0.58), ("moss", 0.24), ("dirt", 0.18)],
    "farm": [("rooted", 0.48), ("grass", 0.30), ("coarse", 0.22)],
}


def pick(r: str, zone: str, d: Dialect = SPARK, names: bool = False) -> str:
    """The block (code, or key if names) of the weighted bin that r falls in; the last one takes what lies beyond."""
    total, upto, branches = sum(w for _, w in PALETTES[zone]), 0.0, []
    value = lambda key: f"'{key}'" if names else str(CODE[key])
    for key, weight in PALETTES[zone]:
        upto += weight / total
        branches.append((f"{r} < {d.num(upto)}", value(key)))
    return case(branches, value(PALETTES[zone][-1][0]))


def uniform(r: str, values: list[str], d: Dialect = SPARK) -> str:
    """One of the values, each as likely; r = 1 gives the last."""
    branches = [(f"{r} * {len(values)} < {k + 1}", f"'{v}'") for k, v in enumerate(values[:-1])]
    return case(branches, f"'{values[-1]}'")


def band(r: str, bands: int, d: Dialect = SPARK) -> str:
    return f"least({d.truncate(f'({r}) * {bands}')}, {bands - 1})"

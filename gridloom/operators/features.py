"""Vector features: classes by tags, widths, which cells boxes and lines touch, source tiles, map projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def raster_info(cells: DataFrame, value: str, metres: float, y_low: int, y_high: int) -> DataFrame:
    """One row (info, meta) beside a raster of heights: a text for people and a JSON object for programs.

    metres: how wide a cell is; heights lie between y_low and y_high once scaled. The extent is that of the cells.
    """
    ends = cells.agg(F.min(value).alias("low"), F.max(value).alias("high"), (F.max("x") - F.min("x") + 1).alias("wide"), (F.max("z") - F.min("z") + 1).alias("deep"))
    each = (F.col("high") - F.col("low")) / (y_high - y_low)
    lines = [
        F.format_string("size %d x %d", "wide", "deep"), F.lit(f"y {y_low} to {y_high}"), F.format_string("horizontal 1 block = %.2f m", F.lit(metres)), F.format_string("vertical 1 block = %.2f m", each),
        F.format_string("%.0f m is y %d", "low", F.lit(y_low)), F.format_string("%.0f m is y %d", "high", F.lit(y_high)),
    ]
    meta = F.to_json(F.struct(F.round("low", 3).alias("elev_min_m"), F.round("high", 3).alias("elev_max_m"), F.lit(y_low).alias("y_min"), F.lit(y_high).alias("y_max"), F.lit(metres).alias("meters_per_block_h"), F.round(each, 6).alias("meters_per_block_v"), F.col("wide").alias("grid")))
    return ends.select(F.concat_ws("\n", *lines).alias("info"), meta.alias("meta"))


#: A caller's list of kinds or classes is broadcast up to so many rows; above, it is joined as a table.
MOST_KINDS = 10_000


def _listed(kinds: DataFrame) -> DataFrame:
    return F.broadcast(kinds) if kinds.limit(MOST_KINDS + 1).count() <= MOST_KINDS else kinds


def with_width(lines: DataFrame, widths: DataFrame, kind: str, default: float) -> DataFrame:
    """lines with width by their kind, or the default; widths(kind, width) is a list of kinds."""
    return lines.join(_listed(widths.withColumnRenamed("kind", "_kind")), F.col(kind) == F.col("_kind"), "left").drop("_kind").withColumn("width", F.coalesce("width", F.lit(default)))


def cells_of_box(boxes: DataFrame, width: int, depth: int) -> DataFrame:
    """Each box(x0, z0, x1, z1) once for each cell of the grid it touches: x, z are added."""
    span = lambda low, high, size: F.sequence(F.greatest(F.lit(0), F.floor(low).cast("int")), F.least(F.lit(size - 1), F.floor(high).cast("int")))
    some = boxes.where((F.floor("x1") >= 0) & (F.floor("x0") < width) & (F.floor("z1") >= 0) & (F.floor("z0") < depth))
    return some.withColumn("x", F.explode(span("x0", "x1", width))).withColumn("z", F.explode(span("z0", "z1", depth)))


def rasterised(touched: DataFrame, code: str, priority: str) -> DataFrame:
    """(x, z, code): of all features on a cell the one of the greatest priority."""
    return touched.groupBy("x", "z").agg(F.max_by(code, priority).alias(code))


def near_segment(x: Column, z: Column, x0: Column, z0: Column, x1: Column, z1: Column, reach: Column) -> Column:
    """Whether a point lies within reach of a segment, its ends cut flat."""
    dx, dz = x1 - x0, z1 - z0
    length = dx * dx + dz * dz
    forward = (x - x0) * dx + (z - z0) * dz
    aside = (x - x0) * dz - (z - z0) * dx
    return (length > 0) & (forward >= 0) & (forward <= length) & (aside * aside <= reach * reach * length)


def resampled(target: DataFrame, source: DataFrame, scale: float, shift: float, value: str = "v") -> DataFrame:
    """target(x, z) with value by bilinear resampling of source(x, z, value) at x * scale + shift; missing neighbours weigh nothing."""
    u, w = F.col("x") * F.lit(scale) + F.lit(shift), F.col("z") * F.lit(scale) + F.lit(shift)
    corners = F.array(*[
        F.struct((F.floor(u) + i).cast("int").alias("sx"), (F.floor(w) + j).cast("int").alias("sz"), ((F.lit(1 - i) + (2 * i - 1) * (u - F.floor(u))) * (F.lit(1 - j) + (2 * j - 1) * (w - F.floor(w)))).alias("k"))
        for i in (0, 1) for j in (0, 1)
    ])
    asked = target.select("x", "z", F.explode(corners).alias("c")).select("x", "z", "c.*")
    met = asked.join(source.select(F.col("x").alias("sx"), F.col("z").alias("sz"), value), ["sx", "sz"]).where((F.col("k") > 0) & F.col(value).isNotNull())
    return met.groupBy("x", "z").agg((F.sum(F.col(value) * F.col("k")) / F.sum("k")).alias(value))


def mosaic(tiles: DataFrame, value: str, order: str) -> DataFrame:
    """(x, z, value) of overlapping tiles: of a cell's known values that of the first tile in order; NaN is unknown."""
    known = tiles.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).where(F.col(value).isNotNull())
    return known.groupBy("x", "z").agg(F.min_by(value, order).alias(value))


def tagged(features: DataFrame, classes: DataFrame) -> DataFrame:
    """features(id, tags map, ...) with the class of their tags: classes(name, code, key, value, priority) is a list of
    tag values. Of several classes a feature takes the one of the greatest priority."""
    pairs = features.withColumn("_tag", F.explode(F.map_entries("tags")))
    listed = _listed(classes.select("name", "code", "priority", F.col("key").alias("_k"), F.col("value").alias("_v")))
    met = pairs.join(listed, (F.col("_tag.key") == F.col("_k")) & (F.col("_tag.value") == F.col("_v"))).drop("_tag", "_k", "_v")
    rest = [c for c in features.columns if c not in ("id", "tags")]
    best = met.groupBy("id").agg(F.max_by(F.struct("name", "code", "priority", *rest), F.struct("priority", "code")).alias("b"))
    return best.select("id", "b.*")


def source_tiles(spark: SparkSession, bounds: tuple[float, float, float, float], tile: int, name: str) -> DataFrame:
    """(path, x0, z0, x1, z1) of the tiles that meet bounds (x0, z0, x1, z1); name has places for a tile's x and z."""
    x0, z0, x1, z1 = bounds
    low = [int(v // tile) for v in (x0, z0)]
    n = [max(0, -int(-v // tile) - a) for v, a in zip((x1, z1), low, strict=True)]
    at = spark.range(n[0] * n[1]).select((F.col("id") % max(1, n[0]) + low[0]).alias("i"), (F.floor(F.col("id") / max(1, n[0])) + low[1]).alias("k"))
    corner = at.select((F.col("i") * tile).cast("int").alias("x0"), (F.col("k") * tile).cast("int").alias("z0"))
    path = F.format_string(name.format(x="%1$d", z="%2$d"), "x0", "z0")
    return corner.select(path.alias("path"), "x0", "z0", (F.col("x0") + tile).alias("x1"), (F.col("z0") + tile).alias("z1"))


def windowed(read: DataFrame, tiles: DataFrame, bounds: tuple[int, int, int, int], step: int = 1) -> DataFrame:
    """(x, z, px) of read(path, x, z, px, error), places within their tiles, moved to their tiles' corners and cut to bounds
    (x0, z0, x1, z1; the last two outside); every step-th cell. Tiles that don't open or aren't there add nothing."""
    placed = read.where("error is null").join(tiles.select("path", "x0", "z0"), "path")
    whole = placed.select((F.col("x") + F.col("x0")).alias("x"), (F.col("z") + F.col("z0")).alias("z"), "px")
    x0, z0, x1, z1 = bounds
    cut = whole.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("z") >= z0) & (F.col("z") < z1))
    return cut.where(((F.col("x") - x0) % step == 0) & ((F.col("z") - z0) % step == 0)) if step > 1 else cut


def utm_back(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Degrees of an easting and northing in a zone: the series of utm(), inverted, and a few steps for the latitude."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    xi = (north - F.when(south, 10_000_000).otherwise(0)) / (0.9996 * big)
    eta = (east - 500_000) / (0.9996 * big)
    x, y = xi, eta
    for k, c in enumerate(series, 1):
        x = x - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    to_phi = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    phi = chi
    for k, c in enumerate(to_phi, 1):
        phi = phi + c * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183), F.degrees(phi)


# fixed values: the equal-area projection of Europe (EPSG 3035): ellipsoid, middle in degrees, false easting and northing
EUROPE = (6378137.0, 1 / 298.257222101, 52.0, 10.0, 4321000.0, 3210000.0)


def _authalic(phi: Column, e: float) -> Column:
    s = F.sin(phi)
    return (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)


def europe(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the equal-area projection of Europe."""
    a, f, lat0, lon0, fe, fn = EUROPE
    e = (2 * f - f * f) ** 0.5
    qp, q0, q = (_authalic(F.radians(p), e) for p in (F.lit(90.0), F.lit(lat0), lat))
    beta, beta0 = F.asin(F.least(F.lit(1.0), q / qp)), F.asin(q0 / qp)
    rq, away = a * F.sqrt(qp / 2), F.radians(lon - lon0)
    phi0 = F.radians(F.lit(lat0))
    d = a * F.cos(phi0) / F.sqrt(1 - e * e * F.sin(phi0) * F.sin(phi0)) / (rq * F.cos(beta0))
    b = rq * F.sqrt(2 / (1 + F.sin(beta0) * F.sin(beta) + F.cos(beta0) * F.cos(beta) * F.cos(away)))
    return fe + b * d * F.cos(beta) * F.sin(away), fn + b / d * (F.cos(beta0) * F.sin(beta) - F.sin(beta0) * F.cos(beta) * F.cos(away))


def europe_back(east: Column, north: Column) -> tuple[Column, Column]:
    """Degrees of an easting and northing in the equal-area projection of Europe."""
    a, f, lat0, lon0, fe, fn = EUROPE
    e2 = 2 * f - f * f
    e = e2**0.5
    qp, q0, phi0 = _authalic(F.radians(F.lit(90.0)), e), _authalic(F.radians(F.lit(lat0)), e), F.radians(F.lit(lat0))
    beta0, rq = F.asin(q0 / qp), a * F.sqrt(qp / 2)
    d = a * F.cos(phi0) / F.sqrt(1 - e2 * F.sin(phi0) * F.sin(phi0)) / (rq * F.cos(beta0))
    x, y = (east - fe) / d, (north - fn) * d
    rho = F.sqrt(x * x + y * y)
    c = 2 * F.asin(rho / (2 * rq))
    beta = F.when(rho == 0, beta0).otherwise(F.asin(F.cos(c) * F.sin(beta0) + y * F.sin(c) * F.cos(beta0) / rho))
    terms = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]
    phi = beta
    for k, t in enumerate(terms, 1):
        phi = phi + t * F.sin(2 * k * beta)
    return F.degrees(F.atan2(x * F.sin(c), rho * F.cos(beta0) * F.cos(c) - y * F.sin(beta0) * F.sin(c))) + lon0, F.degrees(phi)


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees in a zone, by the third-order series in the flattening; well below a millimetre
    within the zone. South of the equator northings count from ten million metres below it."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * n**0.5 / (1 + n)
    phi, away = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, c in enumerate(series, 1):
        east = east + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500_000 + 0.9996 * big * east, F.when(lat < 0, 10_000_000).otherwise(0) + 0.9996 * big * north

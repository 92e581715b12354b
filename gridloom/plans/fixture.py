"""The grid that the queries run on: 64 x 64 cells derived from lineitem, for Spark and as SQL text.

lineitem is summed by (l_partkey % 64, l_suppkey % 64), which combines on the map side, and joined to the generated grid,
so that every cell exists whatever the data. Layers are expressions over coordinates and these sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dialect import DUCK, SPARK, Dialect, column
from gridloom.functions.noise import value_noise
from gridloom.operators.grid import complete, grid

SIZE = 64


def layers(wet: str, d: Dialect) -> dict[str, str]:
    """Layers over coordinates and sums; wet is the expression or column of the noise that makes water."""
    return {
        "elev": f"({d.num(620.0)} + {d.num(1900.0)} * {value_noise('x', 'z', 24, 11, d)} + {d.num(0.25)} * (qty % 8))",
        "landcover": f"cast((ln + 3 * {d.div_floor('x', 8)} + 5 * {d.div_floor('z', 8)}) % 10 as int)",
        "water": f"({wet} > {d.num(0.56)})",
        "depth": f"case when {wet} > {d.num(0.56)} then 1 + cast(floor(({wet} - {d.num(0.56)}) * 60) as int) else 0 end",
        "hm": f"cast((x * 977 + z * 613 + qty * 31) % 65536 as int)",
    }


def _wet(d: Dialect) -> str:
    return value_noise("x", "z", 14, 77, d)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = items.groupBy((F.col("l_partkey") % SIZE).cast("int").alias("x"), (F.col("l_suppkey") % SIZE).cast("int").alias("z")).agg(
        F.sum("l_quantity").cast("long").alias("qty"), F.sum("l_linenumber").cast("long").alias("ln"), F.count("*").alias("n")
    )
    base = complete(grid(spark, SIZE, SIZE), sums, {"qty": 0, "ln": 0, "n": 0})
    base = base.withColumn("wet", column(_wet(SPARK)))
    return base.select("x", "z", "qty", "ln", "n", *[column(e).alias(c) for c, e in layers("wet", SPARK).items()])


CELLS_SQL = f"""base as (
  select cast(g.range as int) as x, cast(h.range as int) as z, coalesce(s.qty, 0) as qty, coalesce(s.ln, 0) as ln, coalesce(s.n, 0) as n
  from range({SIZE}) g cross join range({SIZE}) h left join (
    select l_partkey % {SIZE} as px, l_suppkey % {SIZE} as pz, cast(sum(l_quantity) as bigint) as qty, cast(sum(l_linenumber) as bigint) as ln, count(*) as n
    from lineitem group by 1, 2) s on s.px = g.range and s.pz = h.range),
cells as materialized (select x, z, qty, ln, n, {', '.join(f'{e} as {c}' for c, e in layers(_wet(DUCK), DUCK).items())} from base)"""


def sql(body: str, *steps: str) -> str:
    """A query over the grid: `with base, cells, steps... body`."""
    return "with " + ",\n".join([CELLS_SQL, *steps]) + "\n" + body

"""The queries over whole tables, against plain Python over every row."""

import pyarrow.parquet as pq
import pytest

from gridloom.plans.fixture import cells
from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def column(table, *names):
    return list(zip(*(pq.read_table(f"{SF}/{table}.parquet", columns=[n])[n].to_pylist() for n in names), strict=True))


def rows(spark, name):
    return {tuple(r) for r in QUERIES[name](spark, SF).collect()}


def test_every_order_is_rasterised(spark):
    want = {}
    for key, customer in column("orders", "o_orderkey", "o_custkey"):
        x0, z0, code = key * 13 % 70 - 3 + 0.5, key * 29 % 70 - 3 + 0.25, customer % 9 + 1
        for x in range(64):
            for z in range(64):
                if x0 < x + 1 and x0 + code >= x and z0 < z + 1 and z0 + 3 >= z:
                    want[x, z] = max(want.get((x, z), 0), code)
    assert rows(spark, "rasterise_box") == {(x, z, code) for (x, z), code in want.items()}


def test_every_nation_is_a_line(spark):
    want = set()
    for (n,) in column("nation", "n_nationkey"):
        x0, z0, dx, dz = 4 * n - 20, 2 * n, 90 - 6 * n, 60 - 3 * n
        for x in range(64):
            for z in range(64):
                if 0 <= (x - x0) * dx + (z - z0) * dz <= dx * dx + dz * dz and ((x - x0) * dz - (z - z0) * dx) ** 2 <= 4 * (dx * dx + dz * dz) > 0:
                    want.add((x, z))
    assert rows(spark, "buffer_line") == want


def test_every_event_is_in_the_ledger(spark):
    done = {(e % 4 * 16, u % 3 * 16) for e, u in column("events", "event_id", "user_id")}
    left = [(x, z) for x in range(0, 64, 16) for z in range(0, 64, 16) if (x, z) not in done][:5]
    assert rows(spark, "pending_tiles") == {(f"{x},{z}", x, z) for x, z in left}


def test_every_order_is_in_the_region_files(spark):
    slots = {}
    for key, customer, priority in column("orders", "o_orderkey", "o_custkey", "o_orderpriority"):
        at = (f"r.{customer % 4}.mca", key % 1024)
        slots[at] = min(slots.get(at, priority), priority)
    assert rows(spark, "region_scan") == {(path, s, s % 32, s // 32, 1000 + s, text) for (path, s), text in slots.items()}
    assert rows(spark, "region_compact") == {(path, s, text) for (path, s), text in slots.items() if text[0] in "12"}


def test_every_order_is_unpacked(spark):
    assert rows(spark, "bit_unpack") == {(key, k, (key * 7 + k * 5) % 32) for (key,) in column("orders", "o_orderkey") for k in range(12)}


@pytest.mark.parametrize("name, pick", [("voxel_resolve", max), ("first_write_wins", min)])
def test_every_cell_is_written(spark, name, pick):
    writes = {}
    for c in cells(spark, SF).collect():
        own = [(y, 1, "stone") for y in range(100, 104)] + [(y, 2, "water") for y in range(102, 106) if c.water] + [(103, 3, "plant")] * (c.depth > 2)
        for y, p, block in own:
            writes.setdefault((c.x, y, c.z), []).append((p, block))
    assert rows(spark, name) == {(*at, pick(of)[1]) for at, of in writes.items()}

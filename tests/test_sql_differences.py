"""Rows on which queries once differed from their SQL."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from archivolt.functions import text
from archivolt.plans import registry


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL."""
    connection = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{table}.parquet")
        connection.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = registry.QUERIES[name](spark, str(folder))
    wanted = connection.sql(registry.ORACLES[name])
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    return order(found.select(*wanted.columns).collect()), order(wanted.fetchall())


def test_a_source_without_dates_is_null(spark, tmp_path):
    day = datetime.datetime(1997, 3, 2)
    lines = [{"l_partkey": 1, "l_returnflag": "N", "l_shipdate": day}, {"l_partkey": 2, "l_returnflag": "A", "l_shipdate": day}]
    found, wanted = both(spark, tmp_path, "j27_dates_by_source", lineitem=lines)
    assert found == wanted == [(1, None, None), (2, "1997-03-02", None)]


def test_preferred_rows_that_the_order_leaves_equal(spark, tmp_path):
    line = lambda key, price: {"l_orderkey": key, "l_linenumber": 1, "l_extendedprice": price, "l_shipdate": datetime.datetime(1997, 3, 2), "l_returnflag": "N"}
    seen = []
    for prices in ([3.0, 1.0, 2.0], [1.0, 2.0, 3.0]):
        folder = tmp_path / str(prices[0])
        folder.mkdir()
        pq.write_table(pa.Table.from_pylist([line(1, p) for p in prices]), f"{folder}/lineitem.parquet")
        pq.write_table(pa.Table.from_pylist([{"o_orderkey": 1}]), f"{folder}/orders.parquet")
        seen.append([r.price for r in registry.QUERIES["j28_preferred_or_default"](spark, str(folder)).filter("role = 'primary'").collect()])
    assert len(set(map(tuple, seen))) == 1 and set(seen[0]) == {1.0}


def test_thousandths_of_a_score_just_below_a_half(spark, tmp_path):
    first = bytes.fromhex("897e82807d7f847980807f8084867e7a7e7e807b7d8582817d827f827e797d84" "807785817c81797e7f82807a808576827e7d848a867b7e8177828081837e857c")
    second = bytes.fromhex("827b84827c7e807d857e7e8181877b7f7b7e847e7c8082837d798285867d8184" "81817c7d7f7d7a82807c81867d847e8681797a8084827f7e827f7a7d807f7982")
    vectors = [{"vec_id": i, "embedding": [(x + 0.5) / 32 - 4 for x in pixels], "label": 0} for i, pixels in enumerate((first, second))]
    found, wanted = both(spark, tmp_path, "j10_shortlist_then_dense", embeddings=vectors)
    assert found == wanted and [r[2] % 1000 for r in found] == [220]


def test_no_hit_of_a_band_is_cut(spark, tmp_path):
    # All share the colours; of what shares the quadrants as well, the last by path is the target itself.
    flat = [130.0] * 64
    odd = lambda i: [130.0 + (40.0 if (k + i) % 2 else -40.0) for k in range(64)]
    vectors = [{"vec_id": i, "embedding": [(x + 0.5) / 32 - 4 for x in (flat if i in (0, 99) else odd(i))], "label": 0} for i in range(100)]
    found, wanted = both(spark, tmp_path, "j10_shortlist_then_dense", embeddings=vectors)
    assert found == wanted and ("0", "99", -25_000 * 18, 0, "full", 1) in found


def test_a_restored_letter_and_the_mark_beside_it_are_no_sequence(spark, tmp_path):
    assert text.repaired("FÃ\x89” Ã") == "FÉ” Ã"
    documents = [{"doc_id": i, "text": t} for i, t in enumerate(["MENÜ", "MENÜ", "É"])]
    found, wanted = both(spark, tmp_path, "x15_repaired_text", documents=documents)
    assert found == wanted

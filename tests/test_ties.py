"""Orders that a sort leaves open."""

from quillstone.plans import extract

LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"


def test_lines_of_one_number_and_part_stay_as_stored(spark, tmp_path):
    rows = [(1, 7, 2, 5.0, "N", "F"), (1, 7, 2, 4.0, "A", "F"), (1, 9, 1, 3.0, "N", "O"), (2, 7, 1, 5.0, "R", "F"), (2, 7, 1, 4.0, "N", "F"), (3, 7, 1, 1.0, None, "F")]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: (r.n_rows, r.header_rows) for r in extract.split_header(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 2), 2: (2, 0), 3: (1, 0)}

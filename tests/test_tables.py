"""CSV conventions, headers and grids."""

import pytest
from pyspark.sql import types as T

from driftline.sources import grid, tables


def test_snake_case():
    assert tables.snake_case("NwP") == "nw_p"
    assert tables.snake_case("N") == "n"
    assert tables.snake_case("Oceanographic province (from Longhurst 2007)") == (
        "oceanographic_province_from_longhurst_2007")
    assert tables.snake_case("Mean num particles per indv") == "mean_num_particles_per_indv"


SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
                       T.StructField("n", T.LongType())])


def test_two_blank_conventions(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'a,b,n\r\nx,"one, two",1\r\n,NA,\r\nNA,"",NA')
    rows = tables.read_table(spark, str(path), SCHEMA).collect()
    assert [tuple(r) for r in rows] == [("x", "one, two", 1), (None, None, None),
                                        (None, None, None)]
    rows = tables.read_table(spark, str(path), SCHEMA, blank_is_null=False).collect()
    assert [tuple(r) for r in rows] == [("x", "one, two", 1), ("", None, None), (None, "", None)]


def test_lookup_and_round_trip(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes(b',ProvCode,ProvDescr,adjacency,mean_poll_abund,plasticbin\r\n'
                     b'1,MEDI,"Mediterranean Sea, Black Sea",1,8.5,>10e6\r\n'
                     b'2,ANTA,Polar,0,31.2,10e1')
    df = tables.read_lookup(spark, str(path))
    assert df.columns == ["ProvCode", "ProvDescr", "adjacency", "mean_poll_abund", "plasticbin"]
    out = str(tmp_path / "out")
    tables.write_table(df, out, ["ProvCode"])
    back = tables.read_table(spark, out, df.schema).orderBy("ProvCode").collect()
    assert back == df.orderBy("ProvCode").collect()
    with pytest.raises(Exception):
        tables.write_table(df, out)


def test_repeated_headers(spark):
    df = tables.clean_names(spark.createDataFrame([(1, 2)], "`A b` int, `a.B` int"))
    assert df.columns == ["a_b", "a_b_2"]


def test_grid_from_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("c1,c2,c3,c4\n1,2,3,4\n5,NA,7,8\n")
    (tmp_path / "lat.csv").write_text("10\n-10\n")
    (tmp_path / "lon.csv").write_text("X0.5,X178.5,X181,X359.5\n")
    cells, extent = grid.read_grid(spark, *[str(tmp_path / f) for f in
                                            ("v.csv", "lat.csv", "lon.csv")])
    assert (extent.xmin, extent.xmax, extent.nrow, extent.ncol) == (-179.0, 178.5, 2, 4)
    rows = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    # wrapped longitudes are -179 (column 3), -0.5 (column 4), 0.5, 178.5
    assert rows == {(0, 0): 3.0, (0, 1): 4.0, (0, 2): 1.0, (0, 3): 2.0,
                    (1, 0): 7.0, (1, 1): 8.0, (1, 2): 5.0, (1, 3): None}


def test_grid_of_several_files(spark, tmp_path):
    """Lines follow file names, whatever the sizes of the files and the order of the splits."""
    folder, line = tmp_path / "v", 0
    folder.mkdir()
    for part, lines in enumerate([2, 40, 1, 300, 5]):
        rows = "".join(f"{line + k},{-(line + k)}\n" for k in range(lines))
        (folder / f"part-{part}.csv").write_text("c1,c2\n" + rows)
        line += lines
    (tmp_path / "lat.csv").write_text("".join(f"{90 - k / 4}\n" for k in range(line)))
    (tmp_path / "lon.csv").write_text("X1,X2\n")
    cells, _ = grid.read_grid(spark, str(folder), str(tmp_path / "lat.csv"), str(tmp_path / "lon.csv"))
    got = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert got == {(k, c): float(-k if c else k) for k in range(line) for c in range(2)}

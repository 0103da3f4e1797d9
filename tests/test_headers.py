"""Every CSV file's header counts, not that of one file."""

import pytest

from tidewright.sources import readers


def test_csv_files_with_columns_in_another_order_are_an_error(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\nx,y\n")
    (tmp_path / "2.csv").write_text(' a ,"b"\nz,w\n')
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path), "a string, b string").collect())) == [("x", "y"), ("z", "w")]
    assert readers.read_csv_cells(spark, str(tmp_path)).count() == 2
    (tmp_path / "3.csv").write_text("b,a\ny,x\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_csv(spark, str(tmp_path), "a string, b string")
    with pytest.raises(ValueError, match="headers"):
        readers.read_csv_cells(spark, str(tmp_path))

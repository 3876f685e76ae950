"""The command line on small tables."""

import pandas as pd
import pytest

from stemline import cli
from stemline.config import METHODS


def test_statistics_and_sites(spark, tmp_path):
    rows = [(f"{s}/p{i}", s, m, (i * 7 + k * 3) % 10 / 10, 0.5, 0.4 + k / 20, 0.3) for s in ("NIBIO", "CULS") for i in range(3) for k, m in enumerate(METHODS)]
    pd.DataFrame(rows, columns=["plot", "institution", "method", "f1", "precision", "recall", "coverage"]).to_csv(tmp_path / "c.csv", index=False)
    out = str(tmp_path / "out")
    assert cli.main(["statistics", "--input", str(tmp_path / "c.csv"), "--output", out]) == 0
    assert cli.main(["sites", "--input", str(tmp_path / "c.csv"), "--output", out]) == 0
    assert spark.read.option("header", True).csv(f"{out}/paired_tests").count() == 15
    assert spark.read.option("header", True).csv(f"{out}/bootstrap_ci").count() == 25
    assert spark.read.option("header", True).csv(f"{out}/leave_one_site_out").count() == 15


def test_verify_and_evaluate(spark, tmp_path):
    from tests.test_sources import cloud  # noqa: PLC0415

    spark.createDataFrame(cloud()).write.parquet(str(tmp_path / "p.parquet"))
    for n, status in ((2, 1), (4, 0)):
        (tmp_path / f"e{n}.csv").write_text(f"institution,n_plots,n_trees\nS,2,{n}\n")
        assert cli.main(["verify", "--points", str(tmp_path / "p.parquet"), "--expected", str(tmp_path / f"e{n}.csv")]) == status
    assert cli.main(["explore", "--points", str(tmp_path / "p.parquet")]) == 0
    with pytest.raises(SystemExit):
        cli.main(["grid", "--method", "nope"])

import pytest

from shelfmark.cli import main

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("command", [["totals"], ["ext-breakdown", "--limit", "3"], ["find", "*.jpg", ">1KB"], ["diff"], ["tags", "lab"], ["cleanup", "--strategy", "oldest", "--min-size", "1"]], ids=" ".join)
def test_commands_show_rows(spark, capsys, command):
    assert main(["--tables", TABLES, *command], spark) == 0
    assert "|" in capsys.readouterr().out


def test_errors_and_files(spark, tmp_path, capsys):
    assert main(["--tables", TABLES, "find", "size:nothing"], spark) == 2
    with pytest.raises(SystemExit):
        main(["--tables", TABLES, "diff", "--old", "1"], spark)
    for kind in ("csv", "json", "parquet"):
        assert main(["--tables", TABLES, "--out", str(tmp_path / kind), "--format", kind, "snapshots"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 46
    assert main(["--tables", TABLES, "doctor"], spark) == 1

import io

from tidemark.cli import main


def run(spark, *args):
    out = io.StringIO()
    return main(list(args), spark, out), out.getvalue()


def test_append_scan_inspect(spark, tmp_path, capsys):
    store = str(tmp_path / "s")
    assert run(spark, store, "--tolerant", "append", "--source", "a", "--payload", "x", "--timestamp", "2030-01-01T00:00:00Z") == (0, "appended 1\n")
    lines = tmp_path / "lines"
    lines.write_text('{"timestamp":"2030-01-01T00:00:00.5Z","source":"Yg==","payload":""}\n')
    assert run(spark, store, "append", "--file", str(lines)) == (0, "appended 1\n")
    code, told = run(spark, store, "scan", "--start", "2030-01-01T00:00:00Z", "--end", "2031-01-01T00:00:00Z")
    assert code == 0 and told.splitlines() == ['{"timestamp":"2030-01-01T00:00:00Z","source":"YQ==","payload":"eA=="}', lines.read_text().strip()]
    assert run(spark, store, "scan", "--start", "2030-01-01T00:00:00Z", "--end", "2031-01-01T00:00:00Z", "--source", "b")[1].count("\n") == 1
    assert "2030-01-01T00:00:00Z  2030-01-01T01:00:00Z  open         2" in run(spark, store, "inspect", "partitions")[1]
    assert run(spark, store, "inspect", "log")[1].endswith("2 live files\n")
    lines.write_text("{}\n")
    assert run(spark, store, "append", "--file", str(lines))[0] == 1
    assert run(spark, store, "append", "--timestamp", "2001-01-01T00:00:00Z")[0] == 1 and "late" in capsys.readouterr().err
    assert run(spark, store, "scan", "--start", "yesterday")[0] == 1

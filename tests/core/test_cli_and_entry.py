import json

import __spark_entry__ as entry
from marlstone import cli


def test_index_search_summary(spark, tmp_path, capsys):
    root, target = tmp_path / "docs", str(tmp_path / "index")
    root.mkdir()
    (root / "a.md").write_text("# Title\n\nalpha beta")
    (root / "b.txt").write_text("gamma")
    assert cli.main(["index", target, str(root)]) == 0
    assert json.loads(capsys.readouterr().out) == {"files": 2, "derivatives": 2, "chunks": 2}
    assert cli.main(["search", target, "alpha"]) == 0
    (hit,) = json.loads(capsys.readouterr().out)
    assert hit["path"] == "a.md extracted markdown" and "alpha" in hit["content"]
    assert cli.main(["search", target, "nothing"]) == 2 and cli.main(["search", str(tmp_path / "none"), "x"]) == 3
    capsys.readouterr()
    assert cli.main(["summary", target]) == 0
    rows = {(r["what"], r["value"]): r["n"] for r in json.loads(capsys.readouterr().out)}
    assert rows["handles", "all"] == 4 and rows["edges", "derived_from"] == 2 and rows["by_derivative_type", "<none>"] == 2
    assert cli.main(["tools"]) == 0 and cli.main(["tools", "add", '{"a": 1, "b": 2}']) == 0


def test_entry_points(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(oracles) >= 80
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows == sorted(rows, key=lambda r: (r.score, r.chunk_id))

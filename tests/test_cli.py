"""Commands on small folders: what they print, how they end, and paths that they refuse."""

import json
import os

import pytest

from folium.cli import as_json, run, same_or_inside
from tests.test_operators import lines


def test_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# One\n\nSome words here.\n")
    out = str(tmp_path / "ledger")
    assert run(["import", str(tmp_path / "in"), out], spark) == (0, '{"ok":true,"result":{"documents":1,"blocks":2,"issues":0}}')
    assert json.loads(run(["import", str(tmp_path / "in"), out, "--pretty"], spark)[1])["result"]["documents"] == 1
    assert run(["check", out], spark) == (0, '{"ok":true,"result":{"ok":true,"documents":1,"n_errors":0,"errors":[]}}')
    code, text = run(["outline", out], spark)
    assert code == 0 and [h["text"] for h in json.loads(text)["result"]["headings"]] == ["# One"]
    assert json.loads(run(["search", out, "WORDS"], spark)[1])["result"]["n"] == 1
    (tmp_path / "in" / "b.md").write_text("![far](http://e.org/a.png)\n")
    run(["import", str(tmp_path / "in"), out], spark)
    code, text = run(["check", out], spark)
    assert code == 2 and json.loads(text)["result"]["n_errors"] == 1
    code, text = run(["check", str(tmp_path / "none")], spark)
    assert code == 1 and json.loads(text)["ok"] is False


def test_candidates(spark, tmp_path):
    lines(spark).write.parquet(str(tmp_path / "lines"))
    code, text = run(["candidates", str(tmp_path / "lines"), str(tmp_path / "out"), "--preview", str(tmp_path / "preview")], spark)
    result = json.loads(text)["result"]
    assert code == 0 and result["coverage_ok"] and result["candidates"] == spark.read.parquet(str(tmp_path / "out")).count()
    assert spark.read.parquet(str(tmp_path / "preview")).first()["preview"].startswith("## Page 1")
    for out, preview in (("lines/x", None), ("lines", None), ("out", "out"), ("out", "lines"), ("out", "out/x")):
        argv = ["candidates", str(tmp_path / "lines"), str(tmp_path / out), *(["--preview", str(tmp_path / preview)] if preview else [])]
        assert run(argv, spark)[0] == 1


def test_paths(tmp_path):
    (tmp_path / "a").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "link")
    assert same_or_inside(str(tmp_path / "link" / "new"), str(tmp_path / "a")) and same_or_inside(f"file://{tmp_path}/a", str(tmp_path / "link"))
    assert not same_or_inside(str(tmp_path / "ab"), str(tmp_path / "a")) and not same_or_inside(str(tmp_path), str(tmp_path / "a"))
    assert same_or_inside("hdfs://n/a/b", "hdfs://n/a") and not same_or_inside("hdfs://n/ab", "hdfs://n/a")


@pytest.mark.parametrize(("pretty", "text"), [(False, '{"a":"é"}'), (True, '{\n  "a": "é"\n}')])
def test_json(pretty, text):
    assert as_json({"a": "é"}, pretty) == text

import json

import pytest

from tessella import __main__ as cli


@pytest.fixture
def site(tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.html").write_text('<div><p class="card" style="padding:16px">x</p></div>')
    (tmp_path / "src" / "b.jsx").write_text("const A = () => <div><b>x</b></div>;")
    (tmp_path / "src" / "same.html").write_text("<p>x</p>")
    (tmp_path / "u.css").write_text(".card{top:0}.p-4{padding:16px}")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_outputs_report_and_codes(spark, site, capsys):
    assert cli.main(["src", "--css", "u.css", "--report"]) == 0
    out = site / "tessella-out"
    assert (out / "a.html").read_text() == '<p class="card p-4">x</p>' and (out / "b.jsx").read_text() == "const A = () => <b>x</b>;" and not (out / "same.html").exists()
    shown = capsys.readouterr().out
    assert [x.rsplit("/", 1)[1] for x in shown.splitlines() if x.startswith("wrote")] == ["a.html", "b.jsx"] and "files changed             2" in shown
    (site / "src" / "broken.jsx").write_text("<a><b></a>")
    assert cli.main(["src", "--audit"]) == 1
    got = capsys.readouterr()
    assert "score" in got.out and "broken.jsx: TemplateError" in got.err


def test_dry_run_and_configuration(spark, site, capsys):
    (site / "tessella.json").write_text(json.dumps({"css": ["u.css"], "dry_run": True, "patterns": []}))
    assert cli.main(["src"]) == 0
    assert '-<div><p class="card" style="padding:16px">x</p></div>\n+<div><p class="card p-4">x</p></div>' in capsys.readouterr().out and not (site / "tessella-out").exists()
    (site / "tessella.json").write_text(json.dumps({"speed": 3}))
    assert cli.main(["src"]) == 2
    (site / "tessella.json").unlink()
    assert cli.main([]) == cli.main(["src", "--nope"]) == cli.main(["src", "--safety", "9"]) == 2
    assert cli.main(["gone"]) == 1

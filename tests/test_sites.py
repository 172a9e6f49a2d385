import pytest
from pyspark.sql import functions as F

from tessella.operators import patterns as P
from tessella.operators.optimize import Options, optimized
from tessella.sources import files, stylesheet


def test_problems_and_stylesheets(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.css").write_text(".a{top:0}")
    got = files.problems(spark, [str(tmp_path / n) for n in ("a.html", "b.txt", "gone.html")] + [str(tmp_path)])
    assert [(p.rsplit("/", 1)[1], why) for p, why in got] == [("b.txt", "unsupported"), ("gone.html", "missing")]
    assert [tuple(r) for r in files.read_stylesheets(spark, [str(tmp_path / "c.css")]).collect()] == [(f"{tmp_path}/c.css", ".a{top:0}")]
    with pytest.raises(Exception):
        files.read_stylesheets(spark, [str(tmp_path / "gone.css")]).collect()


def test_outputs_never_land_on_their_source(spark, tmp_path):
    docs = spark.createDataFrame([(f"{tmp_path}/a.html", "<i>", "x"), (f"{tmp_path}/dist/b.html", "<i>", "y"), (f"{tmp_path}/c.html", "same", "same")], "path string, text_before string, text_after string")
    got = {r.path.rsplit("/", 1)[1]: r.written for r in files.write_outputs(docs, str(tmp_path), str(tmp_path)).collect()}
    assert got == {"a.html": None, "b.html": f"{tmp_path}/dist/b.html"} and (tmp_path / "dist/b.html").read_text() == "y" and not (tmp_path / "a.html").exists()


def test_patterns_are_checked():
    with pytest.raises(ValueError):
        P.Pattern("Bad Name", 1, P.flatten_into(), tag="p")
    with pytest.raises(ValueError):
        P.Pattern("all", 1, P.flatten_into())
    with pytest.raises(ValueError):
        P.Pattern("high", 4, P.flatten_into(), tag="p")
    one, two = (P.Pattern(n, s, P.flatten_into(), tag="p") for n, s in (("b", 1), ("a", 2)))
    assert P.ordered([two, one]) == [one, two] and P.ordered([two, one], ["a"]) == [two]
    with pytest.raises(ValueError):
        P.ordered([one, one])
    with pytest.raises(ValueError):
        P.ordered([one], ["zz"])


def test_empty_combinators(spark):
    assert spark.range(1).select(P.all_of(), P.any_of(), P.none_of()).first()[:] == (True, False, True)


def test_sheet_sets_share_files_by_path(spark):
    pages = spark.createDataFrame([(1, "/p/a.html", '<link rel=stylesheet href="x.css"><link rel=stylesheet href="y.css">'), (2, "/p/b.html", '<link rel=stylesheet href="y.css"><link rel=stylesheet href="x.css"><link rel=stylesheet href="x.css">'), (3, "/p/c.html", "<style>.k{top:0}")], "id long, path string, html string")
    css = spark.createDataFrame([("/p/x.css", "X"), ("/p/y.css", "Y")], "path string, css string")
    keyed, sets = stylesheet.sheet_sets(stylesheet.inline_sheets(pages, "id", "html"), "id", stylesheet.linked_files(pages, "id", "path", "html", css), css)
    assert {r.id: r.css for r in keyed.join(sets, "set_id").collect()} == {1: "X\nY", 2: "X\nY", 3: ".k{top:0}"}
    assert pages.select(stylesheet.own_css(F.col("html")).alias("c")).collect()[2].c == ".k{top:0}"


def test_pattern_subsets_and_ceiling():
    sheet = stylesheet.parse(".c{display:contents}")
    text = '<div class="c"><p>x</p></div><span><b>y</b></span><div><i>z</i></div>'
    assert optimized(text, sheet)[0] == "<p>x</p><b>y</b><i>z</i>"
    assert optimized(text, sheet, Options(patterns=("redundant-inline",)))[0] == '<div class="c"><p>x</p></div><b>y</b><div><i>z</i></div>'
    assert optimized(text, sheet, Options(ceiling=1))[0] == '<div class="c"><p>x</p></div><span><b>y</b></span><i>z</i>'


def test_gate_modes():
    sheet = stylesheet.parse(".i{display:inline}")
    text = '<div class="i"><p>x</p></div>'
    assert optimized(text, sheet)[0] == text and optimized(text, sheet, Options(gate="all"))[0] == "<p>x</p>"


@pytest.mark.parametrize("selector,want", [(".a:hover::before", ("a", [":hover"], "::before")), (".a:before", ("a", [], "::before")), (".md\\:p-4", ("md:p-4", [], "")), (".a.b", None), (".a > .b", None), ("div.a", None), (".a:not(.b)", None), ("#x", None)])
def test_utility_selectors(selector, want):
    assert stylesheet.utility_selector(selector) == want


def test_deep_nesting_of_rules_ends():
    import time

    began = time.process_time()
    for css in ("@media x{" * 20_000, ".a{" * 20_000, ".a{&,&{" * 10_000, "a{b{c:d}}" * 20_000):
        stylesheet.parse(css)
    assert time.process_time() - began < 30


def test_stylesheets_of_hostile_pages(spark):
    import time

    texts = [t * 40_000 for t in ("<style ", "<style>", "<link ", "<link rel=stylesheet href='", "</style ", "<style>x</style  ")]
    pages = spark.createDataFrame(list(enumerate(texts)), "id long, html string")
    began = time.time()
    assert pages.select(F.length(stylesheet.own_css(F.col("html")))).count() == 6 and stylesheet.linked_sheets(pages, "id", "html").count() >= 0
    pages.select(F.length(stylesheet.own_css(F.col("html"))).alias("n")).collect()
    assert time.time() - began < 120

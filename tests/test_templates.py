import pytest

from tessella.operators.optimize import Options, optimized
from tessella.sources.templates import TemplateError, looks_like, parse_jsx
from tessella.sources.utilities import Utilities, chain_for, condition, declared, synthetic, vocabulary

UTILITY = Options(provider="utility")


@pytest.mark.parametrize("code", [
    'const f = <T,>(x: T) => x; const r = /<div>/g; const s = "<div><p/></div>"; // <b>', "a < b && c > d", "<div ref={r}><p>x</p></div>", "<div onClick={f}><p>x</p></div>", "<div>{a}<p>x</p></div>",
    "<div><Foo/></div>", "<div dangerouslySetInnerHTML={{__html: h}}/>", "<ul>{xs.map((x) => (x ? <li key={x}><b>{x}</b></li> : null))}</ul>", "`<div>${<b/>}`", "<A.B c={<i/>}/>", "<div>{/* c */}<b>x</b></div>", "",
])
def test_what_code_decides_stays(code):
    assert optimized(code, Utilities(), UTILITY, "jsx")[0] == code


@pytest.mark.parametrize("code", ["return <div", "<a><b></a>", "<a>", "x = 'abc", "`${", "(]"])
def test_broken_templates_are_errors(code):
    with pytest.raises(TemplateError):
        parse_jsx(code)


def test_no_blanks_come_to_stand_after_return():
    code = "function X() { return <div>\n  <div><p>a</p></div>\n</div>; }"
    assert optimized(code, Utilities(), UTILITY, "jsx")[0] == "function X() { return <p>a</p>; }"


def test_kinds():
    assert [looks_like(p, t) for p, t in (("a.TSX", ""), ("a.htm", ""), ("x", " <!DOCTYPE html>"), ("x", "---\n"), ("x", "<template>"), ("x", "y"))] == ["jsx", "html", "html", "astro", "vue", None]


def test_utilities():
    assert dict(declared("md:hover:-mt-2")) == {("(min-width: 768px)|:hover|", "margin-top"): ("-0.5rem", False)}
    assert declared("foo:p-4") is declared("p-[a;b]") is declared("p-[-1px]") is declared("nope") is declared("hover:hover:p-4") is None
    assert chain_for(condition(["hover", "md"])) == "hover:md:" and chain_for("(x)||") is None and condition(["before"]) is None
    assert all(declared(t) for t in vocabulary()) and len({declared(t) for t in vocabulary()}) > 1500
    assert synthetic({"top": ("1px", False)}) == synthetic({"top": ("1px", False)}) != synthetic({"top": ("2px", False)})
    with pytest.raises(ValueError):
        Options(provider="x")
    with pytest.raises(ValueError):
        Options(patterns=("nope",))

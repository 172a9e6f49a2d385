from tessella.operators.edits import edited
from tessella.sources import files

TEXT = '<div id="d"><p>a</p><p>b</p></div>'  # 4 div, 5 p, 6 a, 7 p, 8 b


def edit(op, target, **more):
    return dict.fromkeys(("other", "index", "markup", "grp", "safety")) | {"op": op, "target": target} | more


def outline(tree):
    return [n.text or n.tag for n in tree.root.walk()][4:]


def test_a_group_is_applied_whole_or_not_at_all():
    tree, applied, refused = edited(TEXT, [edit("remove", 5, grp="g"), edit("wrap", 7, markup="<i></i>", grp="g"), edit("unwrap", 5, grp="g"), edit("unwrap", 7)])
    assert outline(tree) == ["div", "p", "a", "b"] and applied == 1
    assert refused == [("unwrap", 5, "target not found")]


def test_refusals():
    for e, why in (
        (edit("unwrap", 4, safety=1), "above the node's floor"), (edit("move", 4, other=5), "new parent lies in the target"), (edit("unwrap", 6), "not a container"), (edit("remove", 0), "target has no parent"),
        (edit("merge", 5, other=4), "not siblings"), (edit("paint", 5), "unknown edit"), (edit("replace", 5, markup=""), "nothing to insert"), (edit("remove", None), "target not found"), (edit("wrap", 5, markup="x"), "not a container"),
    ):
        tree, applied, refused = edited(TEXT, [e])
        assert outline(tree) == ["div", "p", "a", "p", "b"] and applied == 0 and refused[0][2] == why, e


def test_what_was_removed_is_gone_for_later_edits():
    tree, applied, refused = edited(TEXT, [edit("remove", 4), edit("remove", 6)])
    assert outline(tree) == [] and applied == 1 and refused == [("remove", 6, "target not found")]
    tree, applied, _ = edited(TEXT, [edit("merge", 5, other=7), edit("move", 8, other=5, index=-3)])
    assert outline(tree) == ["div", "p", "b", "a"] and applied == 2


def test_scan(spark, tmp_path):
    for name in ("a.html", "b/C.HTM", "b/d.txt", "node_modules/x.html", "b/s.css", "b/tessella-out/y.html"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"<p>{name}</p>")
    (tmp_path / "node_modules" / "bad.html").write_bytes(b"<p>\xff</p>")
    got = files.scan(spark, [str(tmp_path), str(tmp_path / "b")]).collect()
    assert sorted((r.path.split("/")[-1], r.kind, r.text) for r in got) == [("C.HTM", "html", "<p>b/C.HTM</p>"), ("a.html", "html", "<p>a.html</p>")]
    assert [r.path.split("/")[-1] for r in files.stylesheets(spark, str(tmp_path)).collect()] == ["s.css"]
    assert [r.text for r in files.scan(spark, [str(tmp_path / "node_modules")]).collect() if "bad" in r.path] == ["<p>\ufffd</p>"]
    assert files.scan(spark, [str(tmp_path), str(tmp_path)]).count() == 2

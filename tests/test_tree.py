"""Trees of source files, read by tasks, against a walk."""

import os
import random
import tracemalloc

import pytest

import sparkgauge as sg
from sparkgauge.sources import tree as tree_module
from sparkgauge.sources.tree import LOOKED_AT, files_of, parts_of, read_tree


@pytest.fixture
def tree(tmp_path):
    r = random.Random(3)
    folders = [""]
    for _ in range(40):
        folders.append(f"{r.choice(folders)}/{r.choice(['a', '.b', '_c', 'd'])}{r.randrange(50)}")
    for k, folder in enumerate(folders):
        os.makedirs(f"{tmp_path}/t{folder}", exist_ok=True)
        for name in (f"F{k}.swift", f".hidden{k}.swift", f"_low{k}.swift", f"notes{k}.txt")[: 1 + k % 4]:
            with open(f"{tmp_path}/t{folder}/{name}", "w") as f:
                f.write(f"func f{k}() {{ }}")
    return str(tmp_path / "t")


def walked(top, recursive=True):
    found = {os.path.join(d, n) for d, _, names in os.walk(top) for n in names if n.endswith(".swift")}
    return found if recursive else {f for f in found if os.path.dirname(f) == top}


@pytest.mark.parametrize("splits", [1, 3, 64, 1000])
def test_parts_hold_every_file_once(tree, splits):
    parts = parts_of([tree], True, splits)
    found = [f for p in parts for f in files_of(p, ".swift")]
    assert sorted(found) == sorted(walked(tree)) and len(parts) <= LOOKED_AT
    if splits == 64:
        assert max(len([*files_of(p, ".swift")]) for p in parts) < len(found) / 2


@pytest.mark.parametrize("recursive", [True, False])
def test_read(spark, tree, recursive):
    inner = next(d for d, folders, _ in os.walk(tree) if d != tree)
    one = next(iter(walked(inner, False)))
    got = read_tree(spark, [tree, tree, inner, one, f"{tree}/none.txt"][: -1], recursive).collect()
    want = walked(tree, recursive) | walked(inner, recursive)
    assert sorted(r.file_path for r in got) == sorted(want) and all(r.code.startswith("func f") and r.error is None for r in got)


def test_excludes(spark, tree):
    got = {r.file_path for r in read_tree(spark, [tree], True, ["/[.]b", "*bad"], ["*/_low*"]).collect()}
    assert got == {f for f in walked(tree) if "/.b" not in f and "/_low" not in f}


def test_strict_and_tolerant(spark, tree):
    bad = f"{tree}/bad.swift"
    with open(bad, "wb") as f:
        f.write(b"\xff\xfe")
    rows = {r.file_path: r for r in read_tree(spark, [tree], True, tolerant=True).collect()}
    assert rows[bad].code is None and rows[bad].error and len(rows) == len(walked(tree))
    with pytest.raises(Exception, match="cannot read .*bad.swift"):
        read_tree(spark, [tree], True).collect()
    with pytest.raises(sg.InvalidPathError):
        read_tree(spark, [f"{tree}/nowhere"])
    with pytest.raises(sg.SourceError):
        read_tree(spark, [])
    with pytest.raises(sg.NoSourceFilesError):
        sg.analyze(spark, [tree], True, exclude=["."])


def test_what_is_no_text_is_not_read_whole(tmp_path):
    """A large file that is no text costs a task the piece that shows it, not its size."""
    path = tmp_path / "big.swift"
    with open(path, "wb") as f:
        f.write(b"PAR1\xff")
        f.truncate(256 << 20)
    reader = tree_module.TreeReader({"paths": str(tmp_path), "mode": "tolerant"})
    tracemalloc.start()
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["file_path"], r["code"], r["error"]) for r in rows] == [(str(path), None, "'utf-8' codec can't decode byte 0xff in position 4: invalid start byte")]
    assert peak < 32 << 20


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_pieces_are_the_whole(tmp_path, monkeypatch, piece):
    """Any pieces give the text, or the error, of the whole: letters of several bytes, line ends, marks, cut and wrong bytes."""
    monkeypatch.setattr(tree_module, "PIECE", piece)
    for data in ("", "a\r\nb\rc\n", "\ufeffä€😀x", b"a\xe2\x82", b"ab\xe2\x28\xa1", b"abc\xf0\x9f\x98z", b"\xc3", b"\xed\xa0\x80", b"ok \x80"):
        data = data.encode() if isinstance(data, str) else data
        path = tmp_path / "f"
        path.write_bytes(data)
        try:
            want = data.decode("utf-8")
        except UnicodeDecodeError as e:
            want = str(e)
        try:
            got = tree_module.text_of(str(path))
        except sg.SourceError as e:
            got = str(e)
        assert got == want, data

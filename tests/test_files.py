import io
import json
import os

import pytest
from pyspark.sql import functions as F

from quillcount import cli
from quillcount.operators import cached, invalidation
from quillcount.plans import methods
from quillcount.sources import files, state
from quillcount.sources.ignore import IgnoreRules

PLAN = methods.plan("", True, methods.Options(vocabularies={e: "/nowhere" for e in methods.REPORTED_BPE}))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, content in {
        "hello.txt": b"hello there world\n", "main.go": b"package main\n", "nested/deep.txt": b"deep text\n", ".dot": b"x", "_under": b"y z", "empty": b"",
        "photo.png": b"text", "nul.txt": b"ab\0c", "late.txt": b"a" * 512 + b"\0", ".png": b"q", "ignored.txt": b"no", "debug.log": b"no", "build/out.txt": b"no",
        "nested/.gitignore": b"*.txt\n", ".git/config": b"no", "nested/.git/x": b"no", ".gitignore": b"ignored.txt\n*.log\nbuild/\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root


WANTED = [".dot", ".gitignore", "_under", "empty", "hello.txt", "late.txt", "main.go", "nested/.gitignore", "nested/deep.txt"]


def test_walk(tree):
    os.symlink(tree / "nested", tree / "link")
    found = files.walk(str(tree))
    assert [os.path.relpath(p, tree) for p in found.files] == WANTED
    assert (found.skipped_ignore, found.skipped_binary, found.total_files) == (3, 4, 16)


def test_directory_source(spark, tree):
    df = files.directory(spark, str(tree))
    rows = {r.relative_path: r for r in df.collect()}
    assert sorted(rows) == WANTED and bytes(rows["hello.txt"].content) == b"hello there world\n"
    assert rows["hello.txt"].mtime_ns == os.stat(tree / "hello.txt").st_mtime_ns and rows["empty"].size == 0
    assert files.directory(spark, str(tree), contents=False).where("content is not null").count() == 0
    with pytest.raises(FileNotFoundError):
        files.directory(spark, str(_empty(tree)))
    with pytest.raises(ValueError):
        files.file_list(spark, [])
    with pytest.raises(files.BinaryFile):
        files.single_file(spark, str(tree / "photo.png"))
    assert files.single_file(spark, str(tree / "photo.png"), reject_binary=False).count() == 1


def _empty(tree):
    (tree / "void").mkdir()
    return tree / "void"


def test_binary_expressions(spark):
    rows = [("image.png", b"text"), ("a", b"a\0b"), ("b", b"plain"), ("c", b"a" * 512 + b"\0"), ("x/.tiktoken", b""), ("A.PNG", b""), ("a.b/c", b""), ("d", None)]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")
    got = [bool(r[0]) for r in df.select(F.coalesce(files.binary(F.col("path"), F.col("content")), F.lit(False))).collect()]
    assert got == [True, True, False, False, True, True, False, False]


@pytest.mark.parametrize(
    ("rules", "path", "ignored"),
    [("*.log", "a/b.log", True), ("/*.log", "a/b.log", False), ("build/", "build/x", True), ("build/", "build", False), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("*\n!keep", "keep", False), ("# x\n\n", "# x", False), (r"\#x", "#x", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("dir", "dir/x/y", True), ("**/foo", "x/foo", True), ("x/**", "x/y/z", True)],
)
def test_ignore_rules(rules, path, ignored):
    assert IgnoreRules(rules).ignored(path) is ignored


def entry(path="main.txt", size=5, mtime=10, digest="01", kind="text", **tokens):
    return (path, size, mtime, digest, kind, 5, 1, 1, tokens or {"a": 2})


@pytest.mark.parametrize(
    ("changes", "mode", "contracts", "want"),
    [
        ({}, "metadata", ["a"], ("hit", "metadata_assumed")),
        ({"digest": "02"}, "metadata", ["a"], ("hit", "metadata_assumed")),
        ({"digest": "02"}, "verified", ["a"], ("miss", "content_changed")),
        ({"size": 6}, "verified", ["a"], ("miss", "size_changed")),
        ({"mtime": 11}, "verified", ["a"], ("miss", "modtime_changed")),
        ({"kind": "binary"}, "verified", ["a"], ("miss", "classification_changed")),
        ({}, "verified", ["a", "b"], ("partial_hit", "contract_missing")),
        ({}, "verified", ["b"], ("miss", "contract_missing")),
        ({}, "verified", [], ("hit", "verified_match")),
    ],
)
def test_decisions(spark, changes, mode, contracts, want):
    snapshot = spark.createDataFrame([entry()], state.ENTRIES)
    current = spark.createDataFrame([entry(**changes)], state.ENTRIES).select("path", *invalidation.IDENTITY)
    row = invalidation.plan(current, snapshot, contracts, mode).first()
    assert (row.kind, row.reason) == want
    if want[0] == "partial_hit":
        assert (row.reusable, row.missing) == (["a"], ["b"])


def test_rename_and_versions(spark):
    snapshot = spark.createDataFrame([entry()], state.ENTRIES)
    current = spark.createDataFrame([entry("new.txt")], state.ENTRIES).select("path", *invalidation.IDENTITY)
    got = {(r.path, r.kind, r.reason) for r in invalidation.plan(current, snapshot, ["a"], "verified").collect()}
    assert got == {("new.txt", "miss", "entry_missing"), ("main.txt", "stale", "stale_entry")}
    assert invalidation.plan(current, snapshot, ["a"], "verified", snapshot_version=2).first().reason == "schema_mismatch"
    assert invalidation.plan(current, snapshot, ["a"], "verified", root="x", snapshot_root="y").first().reason == "root_mismatch"
    with pytest.raises(ValueError):
        invalidation.plan(current, snapshot, ["a"], "other")


def test_store(spark, tmp_path):
    store = state.ParquetStore(spark, str(tmp_path / "state"))
    root = str(tmp_path)
    frame = lambda *rows: spark.createDataFrame(list(rows), state.ENTRIES)
    assert store.load(root) is None and not store.status(root).present
    assert store.commit(root, frame(entry("one"))) == 1
    assert store.commit(root, frame(entry("two"))) == 2 and store.load(root).entries.count() == 2
    with pytest.raises(state.Conflict):
        store.commit(root, frame(entry("one", size=9)))
    assert store.commit(root, frame(entry("one", b=3)), 2) == 3
    assert dict(store.load(root).entries.where("path = 'one'").first().methods) == {"a": 2, "b": 3}
    assert store.commit_and_prune(root, frame(), frame(entry("one")).select("path"), 3) == 4 and store.load(root).entries.count() == 1
    assert store.commit_and_prune(root, frame(), frame(entry("one")).select("path"), 4) == 4
    with pytest.raises(PermissionError):
        store.commit_and_prune(root, frame(), frame(entry("one")).select("path"), 4, full_walk=False)
    with pytest.raises(state.Conflict):
        store.commit(root, frame(entry("x")), 9)
    pointer = store._pointer(root)
    with open(pointer) as f:
        held = json.load(f)
    with open(pointer, "w") as f:
        json.dump(held | {"schema_version": 9}, f)
    with pytest.raises(state.Incompatible):
        store.load(root)
    assert store.commit(root, frame(entry("again"))) == 1
    with open(pointer, "w") as f:
        f.write("{")
    with pytest.raises(state.Corrupt):
        store.status(root)
    assert sum("quarantine" in p for p in os.listdir(os.path.dirname(pointer))) == 2
    store.clear(root)
    assert store.load(root) is None and os.listdir(os.path.dirname(pointer)) == ["lock"]
    with pytest.raises(Exception, match="invalid entry"):
        store.commit(root, frame(entry("../x")))
    memory = state.MemoryStore(spark)
    assert memory.commit(root, frame(entry())) == 1
    with pytest.raises(state.Conflict):
        memory.commit(root, frame(entry()))


def test_cached_equals_cold(spark, tree, tmp_path):
    store = state.ParquetStore(spark, str(tmp_path / "state"))

    def check(mode, hits, misses):
        got, decisions = cached.count_directory(spark, str(tree), PLAN, store, mode)
        cold, _ = cached.count_directory(spark, str(tree), PLAN)
        assert got.collect() == cold.collect()
        s = invalidation.summary(decisions).first()
        assert (s.hits, s.misses) == (hits, misses)

    check("metadata", 0, 9)
    check("metadata", 9, 0)
    (tree / "hello.txt").write_text("another text\n")
    check("metadata", 8, 1)
    (tree / "added.txt").write_text("new")
    check("verified", 9, 1)
    (tree / "added.txt").unlink()
    check("verified", 9, 0)
    os.rename(tree / "main.go", tree / "other.go")
    check("metadata", 8, 1)
    (tree / ".gitignore").write_text("*.txt\n")
    got = cached.count_directory(spark, str(tree), PLAN, store)[0].first()
    assert got.file_count == 7  # debug.log is back
    info = os.stat(tree / "other.go")
    (tree / "other.go").write_bytes(b"PACKAGE MAIN\n")
    os.utime(tree / "other.go", ns=(info.st_atime_ns, info.st_mtime_ns))
    assert invalidation.summary(cached.count_directory(spark, str(tree), PLAN, store)[1]).first().misses == 0
    assert invalidation.summary(cached.count_directory(spark, str(tree), PLAN, store, "verified")[1]).first().reasons.startswith("content_changed=1")


def test_failing_store_counts_cold(spark, tree):
    class Broken:
        def load(self, root):
            raise state.Corrupt(root)

        def commit_and_prune(self, *a):
            raise OSError("full")

    with pytest.warns(UserWarning):
        got, _ = cached.count_directory(spark, str(tree), PLAN, Broken())
    assert got.first().file_count == 9


def run(*arguments, spark=None, stdin=b""):
    return cli.count(cli.parser().parse_args(arguments), spark, io.BytesIO(stdin))


def test_cli(spark, tree, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv(cli.STATE_VARIABLE, str(tmp_path / "state"))
    assert run("-", "--model", "claude-opus-4", "--tokens", spark=spark, stdin=b"x" * 38) == "10"
    out = json.loads(run("-r", str(tree), "--json", spark=spark))
    assert out["is_directory"] and out["file_count"] == 9 and out["file_size"] == out["characters"]
    assert json.loads(run("-d", "--cache", "--cache-verify", "--verbose", str(tree), "--json", spark=spark)) == out
    assert "mode=verified files=9 hits=0" in capsys.readouterr().err
    assert "Context Usage" in run(str(tree / "hello.txt"), "--model", "gemini-2.5-pro", spark=spark)
    for bad in (["--tokens", "--json"], ["--tokens", "--all"], ["--cache-verify", "x"], ["--cache", "--no-cache", "x"], ["-r"], ["--cache"], ["--provider", "nobody"], [str(tree)], [str(tree / "hello.txt"), "--cache"], [str(tree / "hello.txt"), "--model", "llama-4-scout"]):
        with pytest.raises(cli.UsageError):
            run(*bad, spark=spark)
    with pytest.raises(FileNotFoundError):
        run("nowhere", spark=spark)
    run("-", "--model", "odd", spark=spark, stdin=b"x")
    assert "Unknown model" in capsys.readouterr().err
    assert '"present": true' in cli.state_command(["status", str(tree), "--json"])
    assert cli.state_command(["clear", str(tree)]).startswith("Cleared")
    assert "Present: false" in cli.state_command(["status", str(tree)])


def test_recount_opens_only_what_changed(spark, tmp_path, monkeypatch):
    root = tmp_path / "many"
    root.mkdir()
    for i in range(40):
        (root / f"f{i:02}.txt").write_text(f"text number {i}\n")
    (root / "zero.dat").write_bytes(b"a\0b")
    store = state.ParquetStore(spark, str(tmp_path / "state"))
    cached.count_directory(spark, str(root), PLAN, store)
    (root / "f07.txt").write_text("something else here\n")
    read, opened, load, real = [], [], files.listed_files, open

    def spy(session, folder, paths, contents=True, sniff=False):
        read.extend(os.path.basename(p) for p in paths if contents)
        return load(session, folder, paths, contents, sniff)

    monkeypatch.setattr(files, "listed_files", spy)
    monkeypatch.setattr("builtins.open", lambda f, *a, **k: (opened.append(str(f)), real(f, *a, **k))[1])
    got, decisions = cached.count_directory(spark, str(root), PLAN, store)
    monkeypatch.undo()
    assert read == ["f07.txt", "zero.dat"]  # a file without a stored entry is sniffed anew
    assert not [f for f in opened if f.startswith(str(root))]
    assert got.collect() == cached.count_directory(spark, str(root), PLAN)[0].collect()
    assert (invalidation.summary(decisions).first().hits, invalidation.summary(decisions).first().misses) == (39, 1)


def test_another_rank_table_is_another_contract(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_text("Counting words takes a vocabulary; another one gives another count.\n" * 20)
    store = state.ParquetStore(spark, str(tmp_path / "state"))
    tables = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]
    counted = []
    for table in (*tables, tables[0]):
        plan = methods.plan("r50k_base", False, methods.Options(vocabularies={"r50k_base": table}))
        got = cached.count_directory(spark, str(root), plan, store)[0].first().methods[0].tokens
        assert got == cached.count_directory(spark, str(root), plan)[0].first().methods[0].tokens
        counted.append(got)
    assert counted[0] == counted[2] != counted[1]


def test_damaged_part_files_count_cold(spark, tree, tmp_path):
    store = state.ParquetStore(spark, str(tmp_path / "state"))
    want = cached.count_directory(spark, str(tree), PLAN, store)[0].collect()
    for part in (tmp_path / "state").rglob("part-*.parquet"):
        raw = bytearray(part.read_bytes())
        raw[4 : len(raw) - 8] = b"\xff" * (len(raw) - 12)
        part.write_bytes(raw)
        for check in part.parent.glob(".part-*.crc"):
            check.unlink()
    with pytest.warns(UserWarning, match="stored counts not used"):
        got, _ = cached.count_directory(spark, str(tree), PLAN, store)
    assert got.collect() == want
    assert invalidation.summary(cached.count_directory(spark, str(tree), PLAN, store)[1]).first().misses == 0

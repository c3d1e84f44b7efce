"""Artifact sinks, bounded sinks, source trees and verified copies."""

import hashlib
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pixelframe.sources import artifacts, files, trees

COVERAGE = trees.Coverage(included=("src", "README"), excluded_top=(".git", ".build"), excluded_subtrees=("src/deep/.build",), excluded_anywhere=(".DS_Store",))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, body in {"src/a.py": b"a" * 10, "src/deep/b": b"", "src/deep/er/c": b"c" * 3_000_000, "src/deep/.build/x": b"x", ".git/HEAD": b"h", "src/.DS_Store": b"d", "README": b"r"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    (root / "src/a.py").chmod(0o755)
    return root


def content(folder) -> dict:
    return {p.relative_to(folder).as_posix(): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def test_artifacts_appear_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}", bytes([i]) * i, i % 2 == 0) for i in range(20)] + [("none", None, True)], "file string, content binary, x boolean").repartition(5)
    out = tmp_path / "out"
    artifacts.write(rows, f"file://{out}", executable="x")
    assert content(out) == {f"d{i % 3}/f{i}": bytes([i]) * i for i in range(20)}
    assert all(os.access(out / f"d{i % 3}/f{i}", os.X_OK) == (i % 2 == 0) for i in range(20))
    with pytest.raises(Exception, match="already there"):
        artifacts.write(rows.limit(1), f"file://{out}")
    assert len(content(out)) == 20
    artifacts.write(rows.where("file = 'd1/f1'"), str(out), overwrite=True)
    assert content(out) == {"d1/f1": b"\1"}
    artifacts.write(rows.where("false"), str(tmp_path / "empty"))
    assert (tmp_path / "empty").is_dir() and sorted(p.name for p in tmp_path.iterdir()) == ["empty", "out"]


@pytest.mark.parametrize("bad", ["../x", "/x", "a/../b", "", "a//b", "a\\b", ".", None])
def test_a_bad_name_leaves_nothing(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"f{i}", b"1") for i in range(20)] + [(bad, b"1")], "file string, content binary").repartition(4)
    with pytest.raises(Exception, match="not a file name"):
        artifacts.write(rows, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_repeated_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="several rows"):
        artifacts.write(spark.createDataFrame([("a", b"1"), ("a", b"2")], "file string, content binary"), str(tmp_path / "out"))


def test_retried_tasks_leave_one_file(spark, tmp_path):
    """An attempt that was lost has left parts and files; the commit keeps one of each name and no part."""
    import pyarrow as pa

    writer = artifacts.FolderWriter({"path": f"file://{tmp_path}/out"}, overwrite=False)
    batch = pa.RecordBatch.from_pylist([{"file": "a/b", "content": b"x"}, {"file": "c", "content": b"y"}])
    done = [writer.write(iter([batch])), writer.write(iter([batch]))]
    (Path(writer.staging.removeprefix("file://")) / ".part-lost").write_bytes(b"half")
    assert done[0] == artifacts.Staged(2, 2) and not (tmp_path / "out").exists()
    writer.commit(done[:1])
    assert content(tmp_path / "out") == {"a/b": b"x", "c": b"y"} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_mount_points_are_resolved(spark, tmp_path):
    """A path that only Spark's file systems know."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.here.link./data", f"file://{tmp_path}")
    path = "viewfs://here/data/new/folder"
    assert artifacts.resolved(spark, path) == f"file://{tmp_path}/new/folder"
    files.write_artifacts(spark.createDataFrame([("a", b"1")], "file string, content binary"), path)
    assert (tmp_path / "new/folder/a").read_bytes() == b"1"
    assert files.image_files(spark, path).count() == 1


@pytest.mark.parametrize(("cap", "expected"), [(None, 30), (30, 30), (29, 18), (12, 12), (3, 0)])
def test_crossing_writes_are_rejected_whole(spark, tmp_path, cap, expected):
    sizes = [12, 6, 12]  # after a rejected write later ones stay out, even those that would fit
    rows = spark.createDataFrame([(f"s{k}", i, bytes([65 + i]) * n) for k in range(5) for i, n in enumerate([*sizes, 0])] + [("small", 0, b"x"), ("late", 0, b"l" * 40), ("late", 1, b"l")], "file string, i int, content binary").repartition(4)
    artifacts.write_streams(rows, str(tmp_path / "out"), "file", "i", "content", cap)
    found = content(tmp_path / "out")
    assert {len(found[f"s{k}"]) for k in range(5)} == {expected} and found["s0"] == (b"A" * 12 + b"B" * 6 + b"C" * 12)[:expected]
    assert found["small"] == b"x" and len(found["late"]) == (41 if cap is None else 0)


def test_snapshot(spark, tree):
    found = {r["path"]: r for r in trees.identity(spark, f"file://{tree}", COVERAGE).collect()}
    assert set(found) == {"src/a.py", "src/deep/b", "src/deep/er/c", "README"}
    assert found["src/a.py"]["executable"] and not found["README"]["executable"]
    assert found["src/deep/er/c"]["byte_count"] == 3_000_000 and found["src/deep/er/c"]["sha256"] == hashlib.sha256(b"c" * 3_000_000).hexdigest()
    everything = {r["path"] for r in trees.snapshot(spark, str(tree)).collect()}
    assert len(everything) == 7


@pytest.mark.parametrize(
    ("spoil", "failure"),
    [
        (lambda t: (t / "new").mkdir(), "unboundTopLevel: new"),
        (lambda t: (t / "README").unlink(), "missing: README"),
        (lambda t: (t / "src/deep/.git").mkdir(), "nestedReservedName: src/deep/.git"),
        (lambda t: (t / "src/deep/link").symlink_to("b"), "symbolicLink: src/deep/link"),
        (lambda t: (t / "src/folder").symlink_to("deep"), "symbolicLink: src/folder"),
        (lambda t: ((t / "README").unlink(), (t / "README").symlink_to("src/a.py")), "symbolicLink: README"),
        (lambda t: os.mkfifo(t / "src/pipe"), "unsupportedEntry: src/pipe"),
    ],
)
def test_refusals(spark, tree, tmp_path, spoil, failure):
    known = trees.identity(spark, str(tree), COVERAGE)
    spoil(tree)
    with pytest.raises(ValueError, match=failure):
        trees.identity(spark, str(tree), COVERAGE)
    with pytest.raises(ValueError, match=failure):
        trees.verified_copy(known, str(tree), str(tmp_path / "copy"), COVERAGE)
    assert not (tmp_path / "copy").exists()


def test_a_change_while_reading_is_seen(tree):
    def touch(block):
        os.utime(tree / "src/a.py", ns=(1, 1))

    assert artifacts.read_stable(str(tree), "src/a.py", touch)[3] == "changedWhileReading"
    assert artifacts.read_stable(str(tree), "src/a.py")[3] is None
    assert artifacts.read_stable(str(tree), "src")[3] == "unsupportedEntry"
    assert artifacts.read_stable(str(tree), "none")[3] == "missing"


def test_verified_copy(spark, tree, tmp_path):
    known = trees.identity(spark, str(tree), COVERAGE)
    copy = tmp_path / "copies" / "one"
    trees.verified_copy(known, str(tree), f"file://{copy}", COVERAGE)
    assert content(copy) == {p: (tree / p).read_bytes() for p in ("src/a.py", "src/deep/b", "src/deep/er/c", "README")}
    assert trees.identity(spark, str(copy), COVERAGE).exceptAll(known).count() == 0
    with pytest.raises(Exception, match="already there"):
        trees.verified_copy(known, str(tree), f"file://{copy}", COVERAGE)
    with pytest.raises(ValueError, match="outside"):
        trees.verified_copy(known, str(tree), str(tree / "src" / "copy"), COVERAGE)


@pytest.mark.parametrize(
    ("name", "change", "failure"),
    [
        ("byte_count", "byte_count + 1", "byteCount drifted"),
        ("sha256", "reverse(sha256)", "sha256 drifted"),
        ("executable", "NOT executable", "executable drifted"),
        ("byte_count", "-1", "invalidByteCount"),
        ("sha256", "upper(sha256)", "invalidDigest"),
        ("executable", "null", "invalidFlag"),
        ("path", "'src/../README'", "unsafePath|extra"),
        ("path", "'src/other'", "extra|missing"),
    ],
)
def test_drift_leaves_no_copy(spark, tree, tmp_path, name, change, failure):
    known = trees.identity(spark, str(tree), COVERAGE)
    changed = known.withColumn(name, F.expr(f"CASE WHEN path = 'src/a.py' THEN {change} ELSE {name} END"))
    with pytest.raises(Exception, match=failure):
        trees.verified_copy(changed, str(tree), str(tmp_path / "copy"), COVERAGE)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["tree"]


def test_repeated_entries(spark, tree, tmp_path):
    known = trees.identity(spark, str(tree), COVERAGE)
    with pytest.raises(ValueError, match="repeated"):
        trees.verified_copy(known.union(known), str(tree), str(tmp_path / "copy"), COVERAGE)


def test_equal_base_names(spark, tmp_path):
    for folder, body in (("a", b"1"), ("b", b"2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.png").write_bytes(body)
    manifest = spark.createDataFrame([("a/x.png", 1, hashlib.sha256(b"1").hexdigest()), ("b/x.png", 1, hashlib.sha256(b"1").hexdigest()), ("../z", 1, ""), ("/a/x.png", 1, ""), ("x.png", 1, "")], "file string, byteCount long, sha256 string")
    found = files.verified(files.image_files(spark, str(tmp_path)), manifest, f"file://{tmp_path}").collect()
    assert {r["file"]: r["failure"] for r in found} == {"a/x.png": None, "b/x.png": "content", "../z": "outside", "/a/x.png": "outside", "x.png": "missing"} and len(found) == 5


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    """Spark gives every few small files a task of their own, so tasks grew with files."""
    most = 8 * spark.sparkContext.defaultParallelism
    for i in range(most + 5):
        (tmp_path / f"{i}.ppm").write_bytes(b"x" * (1 + i % 7))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        found = files.image_files(spark, str(tmp_path), cap=3, pattern="*.ppm")
        assert found.rdd.getNumPartitions() == most
        assert sorted(r["path"].rpartition("/")[2] for r in found.collect()) == sorted(f"{i}.ppm" for i in range(most + 5) if i % 7 <= 2)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)

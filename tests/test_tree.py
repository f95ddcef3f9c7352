"""The source tree on disk: links, secrets and sizes are known before anything is opened."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline import dims
from plumbline.operators import gates
from plumbline.plans import run_queries
from plumbline.sources import tree


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "a tree"
    for path, text in {
        "app.py": "import os\n", "src/deep/er/est/x.py": "x = 1\n", "src/deep/y.py": "é", "src/.env": "KEY=1", "empty.py": "", "src/bad.py": None,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"\xff\xfeok" if text is None else text.encode())
    (root / "large.py").write_bytes(b"x" * (dims.MAX_SOURCE_BYTES + 1))
    (tmp_path / "credentials").write_text("aws_secret_access_key = hidden")
    os.symlink(tmp_path / "credentials", root / "config.py")
    os.symlink(root, root / "src" / "round")  # a cycle
    os.symlink("nowhere", root / "src" / "gone.py")
    os.symlink("self.py", root / "src" / "self.py")
    return root


def test_the_walk_lists_links_and_goes_round_no_cycle(spark, folder):
    for shares in (1, 3, 50):
        rows = tree.list_tree(spark, str(folder), shares).collect()
        assert sorted((r.path, r.is_symlink) for r in rows) == [
            ("app.py", False), ("config.py", True), ("empty.py", False), ("large.py", False), ("src/.env", False),
            ("src/bad.py", False), ("src/deep/er/est/x.py", False), ("src/deep/y.py", False),
        ]
    with pytest.raises(FileNotFoundError):
        tree.list_tree(spark, str(folder / "missing"))


def test_refused_files_are_never_opened(spark, folder):
    os.chmod(folder / "large.py", 0)
    for root in (str(folder), folder.as_uri(), f"file:{folder}"):
        files = tree.scan_source_tree(spark, root, "r")
        got = {r.path: r.text for r in files.collect()}
        assert got == {
            "app.py": "import os\n", "config.py": None, "empty.py": "", "large.py": None, "src/.env": None, "src/bad.py": "��ok",
            "src/deep/er/est/x.py": "x = 1\n", "src/deep/y.py": "é",
        }
        refused = {r.path: r.refusal for r in gates.refuse_files(files).collect() if r.refusal}
        assert refused == {
            "config.py": "symlink", "large.py": "larger than the source size cap", "src/.env": "holds live credentials and is never read",
        }
    assert "text" not in tree.scan_source_tree(spark, str(folder), with_text=False).columns


def test_a_file_that_became_a_link_is_not_opened(spark, folder, tmp_path):
    listed = gates.refuse_files(tree.list_tree(spark, str(folder))).where("path in ('app.py', 'empty.py')")
    rows = spark.createDataFrame(listed.collect(), listed.schema)
    (folder / "app.py").unlink()
    os.symlink(tmp_path / "credentials", folder / "app.py")
    (folder / "empty.py").unlink()
    assert [r.text for r in tree.read_admitted(rows, str(folder)).collect()] == [None, None]


def test_batches_are_cut_by_bytes_and_the_store_form_agrees(spark, folder, monkeypatch):
    listed = gates.refuse_files(tree.list_tree(spark, str(folder)))
    small = {r.path: r.text for r in tree.read_admitted(listed, str(folder), batch_bytes=1).collect()}
    assert small == {r.path: r.text for r in tree.read_admitted(listed, str(folder)).collect()}
    monkeypatch.setattr(tree, "local_folder", lambda root: None)
    os.unlink(folder / "config.py")  # a store has no links
    os.unlink(folder / "src" / "round")
    os.unlink(folder / "src" / "gone.py")
    os.unlink(folder / "src" / "self.py")
    stored = tree.scan_source_tree(spark, str(folder), "r")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in stored.where(F.col("path").like("%.py")).collect()}
    assert got == {k.rsplit("/", 1)[-1]: v for k, v in small.items() if k not in ("config.py", "empty.py", "src/.env")}


def test_files_are_written_by_many_tasks_as_the_partitioned_writer_lays_them_out(spark, tmp_path):
    rows = spark.createDataFrame([(i % 40, f"t{i}é") for i in range(120)] + [(None, "n"), (7, None)], "k int, value string").repartition(5)
    tree.write_files(rows, str(tmp_path / "own"), "k", "txt")
    rows.write.partitionBy("k").text(str(tmp_path / "spark"))

    def laid(root):
        return sorted((p.parent.name, sorted(p.read_text().splitlines())) for p in root.rglob("*.txt"))

    assert laid(tmp_path / "own") == laid(tmp_path / "spark") and len(laid(tmp_path / "own")) > 41
    assert not [p for p in (tmp_path / "own").rglob("*") if p.is_file() and p.suffix != ".txt"]


def test_recordings_are_written_by_more_than_one_task(spark, monkeypatch):
    dealt = []
    write = run_queries.one_file_each
    monkeypatch.setattr(run_queries, "one_file_each", lambda rows, *a: (dealt.append(rows.rdd.getNumPartitions()), write(rows, *a))[1])
    found = entry.queries()["S06_scan_recordings"](spark, "/root/testdata/sf0.001")
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found.count() == conversations.select("conv_id").distinct().count() and dealt[0] > 1
    assert found.groupBy().sum("items").first()[0] == conversations.count()


def test_folders_enough_for_all_tasks_are_each_listed_by_one(tmp_path, monkeypatch):
    for i in range(100):
        (tmp_path / f"d{i}" / "in").mkdir(parents=True)
        (tmp_path / f"d{i}" / "in" / "x.py").write_text("x")
    listed = []
    scan = os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda path: (listed.append(path), scan(path))[1])
    reader = tree.TreeReader({"path": str(tmp_path), "shares": "4"})
    shares = reader.partitions()
    found = [path for share in shares for batch in reader.read(share) for path in batch.column("path").to_pylist()]
    assert sorted(found) == sorted(f"d{i}/in/x.py" for i in range(100))
    assert len(listed) <= 1 + 4 + 200  # the driver's and each task's look at the root, then every folder once

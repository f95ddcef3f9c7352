"""Reading source trees."""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline import dims
from plumbline.functions import text as t
from plumbline.operators.gates import refuse_files

LISTED = "path string, size long, is_symlink boolean"
ENOUGH_FOLDERS = 16


class SourceTree(DataSource):
    """Names, sizes and links under a folder that all executors see; no file is opened and no link is followed.

    Options: ``path``, ``shares`` (tasks) and ``depth``. Every task lists the folders of the first levels and takes its share of
    their entries by a checksum of the name; what lies deeper belongs whole to the task that its folder fell to. There are
    ``depth`` such levels, or fewer where one has folders enough for all tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.shares, self.depth = options["path"], int(options.get("shares", 8)), int(options.get("depth", 2))

    def partitions(self) -> list[InputPartition]:
        depth, level = 1, _folders_in(self.root, [""])
        while depth < self.depth and len(level) < ENOUGH_FOLDERS * self.shares:
            depth, level = depth + 1, _folders_in(self.root, level) if depth + 1 < self.depth else []
        return [InputPartition((share, depth)) for share in range(self.shares)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def batch():
            columns = zip(*held, strict=True) if held else ([], [], [])
            kinds = (pa.string(), pa.int64(), pa.bool_())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, names=["path", "size", "is_symlink"])

        for row in self._walk(*partition.value):
            held.append(row)
            if len(held) == 10_000:
                yield batch()
                held.clear()
        if held:
            yield batch()

    def _walk(self, share: int, levels: int) -> Iterator[tuple]:
        """Files of one share. A link counts if it leads to a file, as a link; a link to a folder is not gone into."""
        waiting = [("", 0, False)]
        while waiting:
            folder, depth, owned = waiting.pop()
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in entries:
                    path = f"{folder}/{entry.name}" if folder else entry.name
                    mine = owned or crc32(os.fsencode(path)) % self.shares == share
                    if entry.is_dir(follow_symlinks=False):
                        if depth + 1 < levels:
                            waiting.append((path, depth + 1, owned))
                        elif mine:
                            waiting.append((path, depth + 1, True))
                    elif mine and (entry.is_file(follow_symlinks=False) or entry.is_symlink() and _leads_to_file(entry)):
                        size = entry.stat(follow_symlinks=False).st_size
                        yield os.fsencode(path).decode(errors="replace"), size, entry.is_symlink()


def _folders_in(root: str, folders: list[str]) -> list[str]:
    found = []
    for folder in folders:
        with os.scandir(os.path.join(root, folder)) as entries:
            found += [os.path.join(folder, e.name) for e in entries if e.is_dir(follow_symlinks=False)]
    return found


def _leads_to_file(entry: os.DirEntry) -> bool:
    """False too for a link that leads nowhere or round in a circle."""
    try:
        return entry.is_file()
    except OSError:
        return False


def local_folder(root: str) -> str | None:
    """The folder a path names, or None where it lies in a store that only Spark reads."""
    if root.startswith("/"):
        return root
    parts = urlparse(root)
    return unquote(parts.path) if parts.scheme == "file" else None


def write_files(rows: DataFrame, folder: str, by: str, ending: str) -> None:
    """``value`` of every row as a line of the file ``folder/by=…/part-<task>.<ending>``, one file per task and value of ``by``.

    What ``write.partitionBy(by).text(folder)`` leaves, in a folder that all executors see, but written by the tasks alone:
    Spark's writer starts a process for the rights of each local file and its driver renames them one by one. A file takes its
    name when it is whole, and a task that runs again writes the same names.
    """
    os.makedirs(folder)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name, unready = f"part-{task.partitionId():05d}.{ending}", f".part-{task.taskAttemptId()}"
        key, lines, count = None, [], 0

        def put() -> None:
            place = os.path.join(folder, f"{by}={key}")
            os.makedirs(place, exist_ok=True)
            with open(os.path.join(place, unready), "wb") as file:
                file.writelines(lines)
            os.replace(os.path.join(place, unready), os.path.join(place, name))

        for batch in batches:
            for value, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = quote(value, safe=" !$&()+,;<>@|}~") if value else "__HIVE_DEFAULT_PARTITION__"
                if lines and value != key:
                    put()
                    lines, count = [], count + 1
                key = value
                lines.append((line or "").encode() + b"\n")
        if lines:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([count + bool(lines)], pa.int64())], names=["files"])

    keyed = rows.select(F.col(by).cast("string").alias("_by"), "value").sortWithinPartitions("_by")
    keyed.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def list_tree(spark: SparkSession, root: str, shares: int | None = None) -> DataFrame:
    """(path, size, is_symlink) of every file under ``root``; nothing is read of any of them.

    A store that only Spark reads has no links. A folder that isn't there is an error.
    """
    folder = local_folder(root)
    if folder is not None:
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"{root} is not a folder")
        spark.dataSource.register(SourceTree)
        tasks = shares or 2 * spark.sparkContext.defaultParallelism
        return spark.read.format("source_tree").option("shares", tasks).load(folder)
    found = _stored(spark, root)
    return found.select("path", "size", "is_symlink")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Files of a store, with ``content``, which is only read where it is asked for."""
    marker = (root.rstrip("/") + "/").split(":", 1)[-1].lstrip("/")
    path = F.element_at(F.split(F.col("path"), F.lit(quoted_pattern(marker)), 2), -1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(path.alias("path"), F.col("length").alias("size"), F.lit(False).alias("is_symlink"), "content")


def read_admitted(files: DataFrame, folder: str, batch_bytes: int = 8_000_000) -> DataFrame:
    """``files`` with ``text`` for the rows whose ``refusal`` is null; no other file is opened.

    A file that has become a link since it was listed, or is gone, has no text: a link is never opened. No more than the size
    cap is read. Bytes that are not UTF-8 are replaced. A batch holds about ``batch_bytes`` of text.
    """
    shape = T.StructType([*files.schema.fields, T.StructField("text", T.StringType())])
    most = dims.MAX_SOURCE_BYTES

    def text_of(path: str) -> str | None:
        try:
            handle = os.open(os.path.join(folder, path), os.O_RDONLY | os.O_NOFOLLOW)
        except OSError as gone:
            if gone.errno in (errno.ELOOP, errno.ENOENT, errno.EMLINK):
                return None
            raise
        with os.fdopen(handle, "rb") as file:
            content = file.read(most + 1)
        return content.decode(errors="replace") if len(content) <= most else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            paths, refused = batch.column("path").to_pylist(), batch.column("refusal").is_valid().to_pylist()
            texts, start, held = [], 0, 0
            for k, path in enumerate(paths):
                texts.append(None if refused[k] else text_of(path))
                held += len(texts[-1] or "")
                if held > batch_bytes or k + 1 == len(paths):
                    part = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=shape.names)
                    texts, start, held = [], k + 1, 0

    return files.mapInArrow(run, shape)


def scan_source_tree(spark: SparkSession, root: str, repo_id: Column | str = "repo", with_text: bool = True) -> DataFrame:
    """``files(repo_id, path, size, is_symlink, text)`` of everything under ``root``.

    Facts come first: a file is only opened once its name, its size and its not being a link admit it (``refuse_files``), and
    a refused one has a null text. Bytes that are not UTF-8 are replaced. With ``with_text=False`` no file is opened at all.
    In a store that only Spark reads, no content of an oversized file is read, that of a secret one is dropped unseen, and
    Spark's file source passes over empty files and names that begin with a dot or underscore.
    """
    named = (F.lit(repo_id) if isinstance(repo_id, str) else repo_id).alias("repo_id")
    facts = ["path", "size", "is_symlink"]
    if not with_text:
        return list_tree(spark, root).select(named, *facts)
    folder = local_folder(root)
    if folder is not None:
        return read_admitted(refuse_files(list_tree(spark, root)), folder).select(named, *facts, "text")
    stored, within = _stored(spark, root), F.col("size") <= dims.MAX_SOURCE_BYTES
    small, large = stored.where(within), stored.where(~within)
    text = F.when(F.col("refusal").isNull(), F.make_valid_utf8(F.col("content").cast("string"))).alias("text")
    return refuse_files(small).select(named, *facts, text).unionByName(
        large.select(named, *facts, F.lit(None).cast("string").alias("text"))
    )


def quoted_pattern(text: str) -> str:
    return "\\Q" + text + "\\E"


def context_files(files: DataFrame) -> DataFrame:
    """Named deployment files at the root of each repository, never secrets, cut to 4,000 characters."""
    kept = files.filter(
        F.col("path").isin(*dims.CONTEXT_FILES) & ~F.col("is_symlink") & ~t.is_live_secret(F.col("path"))
    )
    return kept.select("repo_id", F.col("path").alias("name"), F.substring("text", 1, dims.MAX_CONTEXT_CHARS).alias("text"))

"""Trees of source files as a data source: ``spark.read.format("tree")`` and ``df.write.format("tree")``.

Spark's own readers hide files and folders whose names start with ``_`` or ``.``; a source tree has such files
(``__init__.py``), so this one lists for itself. ``read_tree`` has folders listed by tasks and lets the driver deal the files, in
order of their paths, by bytes, only where they are few; those of a larger tree stay in a table, dealt by their paths, and the
driver holds none of them. Read by its format alone, a tree is listed on the driver, as Spark's are. Roots are URIs of any file
system that pyarrow opens, or plain paths that driver and executors share.
"""

from __future__ import annotations

import math
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pyspark.sql import functions as F

from lodestrata.functions.tables import cut, dealt

#: Bytes of files that a task reads, what opening a file counts as, and bytes of text that are handed over at once.
PART_BYTES, OPEN_BYTES, BATCH_BYTES = 32 << 20, 64 << 10, 4 << 20
#: Parts beyond which opening a file counts as less, so that many small files are not many thousands of tasks.
MANY_PARTS = 1000
#: Files that the driver lists at most, and names below a folder beyond which a task hands on the folders that are left.
LISTED, WALKED = 20_000, 50_000
#: Names that are handed over at once.
BATCH_ROWS = 10_000
_SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("text", pa.string())])


def _opened(root: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs  # imported where it is used: it starts its own threads

    if re.match(r"file:/[^/]", root):
        root = root.removeprefix("file:")
    return fs.FileSystem.from_uri(root)


@dataclass
class Files(InputPartition):
    """Files, as paths below the root, that one task reads."""

    names: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)
        self.most, self.walked = int(options.get("partBytes", PART_BYTES)), WALKED

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = _opened(self.root)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((posixpath.relpath(f.path, base), f.size) for f in found if f.type == fs.FileType.File)
        files = [(name, size) for name, size in files if self._asked(name)]
        parts = sum(size + OPEN_BYTES for _, size in files) / self.most
        opening = OPEN_BYTES if parts <= MANY_PARTS else int(OPEN_BYTES * MANY_PARTS / parts)
        out, held = [], self.most
        for name, size in files:
            if not out or held + size > self.most:
                out.append(Files([]))
                held = 0
            out[-1].names.append(name)
            held += size + opening
        return out or [Files([])]

    def _asked(self, name: str) -> bool:
        return not self.suffixes or posixpath.splitext(name)[1].lower() in self.suffixes

    def walk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(path, size) of the files below folders (path), and those of their folders that are left to be listed, without a size."""
        from pyarrow import fs

        store, base = _opened(self.root)
        rows: list[tuple] = []
        for top in (x for batch in batches for x in batch["path"].to_pylist()):
            folders, seen = [top], 0
            while folders and seen <= self.walked:
                at = folders.pop()
                found = store.get_file_info(fs.FileSelector(posixpath.join(base, at)))
                seen += len(found)
                folders += [posixpath.join(at, f.base_name) for f in found if f.type == fs.FileType.Directory]
                rows += [(posixpath.join(at, f.base_name), f.size) for f in found if f.type == fs.FileType.File and self._asked(f.base_name)]
            rows += [(x, None) for x in folders]
            if len(rows) >= BATCH_ROWS:
                yield self._listed(rows)
                rows = []
        yield self._listed(rows)

    def _listed(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _SCHEMA.field(i).type) for i in range(2)], names=["path", "size"])

    def texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What ``read`` gives of files (path)."""
        for batch in batches:
            yield from self.read(Files(batch["path"].to_pylist()))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Texts in UTF-8, other bytes replaced, with plain line ends."""
        store, base = _opened(self.root)
        rows, held = [], 0
        for name in partition.names:
            with store.open_input_stream(posixpath.join(base, name)) as f:
                data = f.read()
            text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            rows.append((name, len(data), text))
            held += len(text)
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(_SCHEMA)], schema=_SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    """A file a row (path, and text or binary content), put in place whole under its name, so that a task that is tried again writes the same."""

    def __init__(self, options, overwrite: bool):
        if overwrite:
            raise ValueError("a tree is written in append mode: files of the same path are replaced, others stay")
        self.root = options["path"].rstrip("/")

    def write(self, iterator) -> Written:
        store, base = _opened(self.root)
        made, n = set(), 0
        for row in iterator:
            name, data = row[0], row[1]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no path below the root")
            place = posixpath.join(base, name)
            folder = posixpath.dirname(place)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            draft = posixpath.join(folder, f".{uuid.uuid4().hex}.draft")
            with store.open_output_stream(draft) as f:
                f.write(data.encode() if isinstance(data, str) else bytes(data or b""))
            store.move(draft, place)
            n += 1
        return Written(n)


class TreeSource(DataSource):
    """Options: path, suffixes (comma-joined, with their dots; all files without), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, text string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options, overwrite)


def listed(spark: SparkSession, reader: TreeReader) -> DataFrame:
    """(path, size) of the files that ``reader`` asks for, listed by tasks, in as many rounds as the tree is deep at most."""
    left, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = cut(left.mapInArrow(reader.walk, "path string, size long"))
        files = found.where("size is not null")
        out = files if out is None else out.unionByName(files)
        left = dealt(found.where("size is null").select("path"), "path")
        if left.isEmpty():
            return out


def read_tree(spark: SparkSession, root: str, suffixes: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, size, text) of all files below ``root``, hidden ones too; paths start below the root."""
    options = {"partBytes": str(part_bytes)} | ({"suffixes": ",".join(suffixes)} if suffixes else {})
    reader = TreeReader(options | {"path": root})
    files = listed(spark, reader)
    n, held = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    if n <= LISTED:
        spark.dataSource.register(TreeSource)
        return spark.read.format("tree").options(**options).load(root)
    parts = max(math.ceil(held / part_bytes), min(MANY_PARTS, math.ceil((held + n * OPEN_BYTES) / part_bytes)))
    return files.select("path").repartition(parts, "path").mapInArrow(reader.texts, "path string, size long, text string")


def write_tree(files: DataFrame, root: str) -> None:
    """``files`` (path below the root, text or binary content) as files below ``root``, dealt to tasks by their paths; where paths repeat, one stands."""
    files.sparkSession.dataSource.register(TreeSource)
    dealt(files, "path").write.format("tree").mode("append").save(root)

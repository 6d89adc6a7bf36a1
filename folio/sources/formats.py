"""Documents as a data source: ``spark.read.format("folio")`` and ``df.write.format("folio")``.

Paths are URIs of any file system that pyarrow opens (local or mounted folders,
object stores, HDFS); driver and executors must reach them alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from folio.sources.files import READERS

#: Bytes of files that a task reads, if none is larger.
TASK_BYTES = 64 << 20


def at(uri: str):
    """The file system and path of a URI or local path."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://|file:", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Registry:
    """Readers, bytes to Markdown, by extension and by name. Those of one's own go to
    the tasks with the plan, from the time of registered() on."""

    def __init__(self) -> None:
        self.by_extension = dict(READERS)
        self.by_name = {e.removeprefix("."): e for e in READERS}

    def register(self, name: str, extensions: Iterable[str], read) -> None:
        for e in extensions:
            self.by_extension[e.lower()] = read
            self.by_name[name] = e.lower()

    def of(self, path: str):
        return self.by_extension.get(re.search(r"(\.[^./]*)?$", path)[0].lower())


registry = Registry()


@dataclass
class Files(InputPartition):
    """Paths that a task reads."""

    paths: list[str]


class DocumentReader(DataSourceReader):
    """Files to path, text and error; a file that can't be read costs its own row only.

    Conditions on the path are used before any file is opened: equal, in a list,
    its beginning and its end.
    """

    def __init__(self, options: dict, columns: list[str], formats: Registry):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.columns = options["path"], columns
        self.readers = formats.by_extension
        wanted = options.get("format")
        self.ends = tuple(e for e in self.readers if wanted is None or e == formats.by_name.get(wanted, f".{wanted}"))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("path",):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(("equal", f.value))
            elif isinstance(f, In):
                self.tests.append(("in", list(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("starts", f.value))
            elif isinstance(f, StringEndsWith):
                self.tests.append(("ends", f.value))
            else:
                yield f

    def wanted(self, path: str) -> bool:
        tests = {"equal": str.__eq__, "in": lambda p, v: p in v, "starts": str.startswith, "ends": str.endswith}
        return all(tests[kind](path, value) for kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, top = at(self.root)
        info = system.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(top) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.ends) and not hidden(f.path) and self.wanted(f.path))
        out, size = [Files([])], 0
        for path, n in files:
            if out[-1].paths and size + n > self.task_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = at(self.root)
        for path in partition.paths:
            text = error = None
            try:
                with system.open_input_file(path) as f:
                    text = self.readers[re.search(r"\.[^./]*$", path)[0].lower()](f.read())
            except Exception as e:  # noqa: BLE001 - any defect of a file is its row's error
                error = f"{type(e).__name__}: {e}"[:500]
            of = {"path": path, "text": text, "error": error}
            yield tuple(of[c] for c in self.columns)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: staged and final names."""

    moves: list[tuple[str, str]]


class DocumentWriter(DataSourceWriter):
    """Rows (path: relative, content: bytes or text) to files of those names.

    Tasks write into a folder of the job's own, hidden from readers. The commit
    moves the files of the tasks that have succeeded to their places; an abort, or
    a name that two rows have, leaves nothing. Files that are replaced only in
    mode overwrite; else the job fails before anything is moved.
    """

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.root, self.columns, self.overwrite = options["path"], columns, overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, top = at(self.root)
        moves, mine = [], uuid.uuid4().hex  # attempts of a task don't meet
        system.create_dir(f"{top}/{self.job}/{mine}", recursive=True)
        for k, row in enumerate(iterator):
            name, content = row[self.columns.index("path")], row[self.columns.index("content")]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a relative path: {name!r}")
            staged = f"{top}/{self.job}/{mine}/{k}"
            with system.open_output_stream(staged) as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            moves.append((staged, f"{top}/{name}"))
        return Written(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, top = at(self.root)
        moves = [m for x in messages if x for m in x.moves]
        names = [to for _, to in moves]
        try:
            if len(set(names)) < len(names):
                raise ValueError("two rows have one path")
            there = [i.path for k in range(0, len(names), 1000) for i in system.get_file_info(names[k : k + 1000]) if i.type != fs.FileType.NotFound]
            if there and not self.overwrite:
                raise FileExistsError(there[0])
            for staged, to in moves:
                system.create_dir(to.rpartition("/")[0], recursive=True)
                system.move(staged, to)
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, top = at(self.root)
        if system.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.job}")


class Documents(DataSource):
    """The format "folio"."""

    formats = registry

    @classmethod
    def name(cls) -> str:
        return "folio"

    def schema(self) -> str:
        return "path string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        unknown = set(schema.names) - {"path", "text", "error"}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return DocumentReader(dict(self.options), schema.names, self.formats)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("rows to write have path and content")
        return DocumentWriter(dict(self.options), schema.names, overwrite)


def registered(spark: SparkSession, given: Registry = registry) -> SparkSession:
    """The session with the format as it is now, and pushed conditions switched on."""

    class Given(Documents):
        formats = given

    spark.dataSource.register(Given)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark

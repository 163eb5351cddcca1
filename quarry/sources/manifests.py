"""Manifests and object listings as data sources of Spark.

A manifest is one JSON object of canonical text: a header's fields and, under
``members``, one object a member, ids strictly ascending. The sink writes it
as a stream through one sorted task that holds one member at a time (a
manifest has at most ``MOST_BYTES``, which is checked before anything is
written), hashes what it writes, and moves the file to its place when the job
commits; a job that fails leaves nothing. The source verifies size and digest,
then reads members as a stream.

The listing walks a tree of folders, a task for each folder at the top, and
leaves out what a condition on the path excludes.
"""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage

# Workers get this module's classes with their task: they needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: the most bytes of one manifest. Bytes that are read at a time.
MOST_BYTES, CHUNK = 256 << 20, 1 << 20
MEMBER = "sample_id string, member string"


def _files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _frame(header: dict) -> tuple[bytes, bytes]:
    """The manifest's text before and after its members."""
    text = json.dumps(header | {"members": []}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    mark = '"members":['
    # The first key of that name at the top: keys are sorted, and no text holds an unescaped quote.
    depth, at, quoted = 0, 0, False
    while at < len(text):
        c = text[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif depth == 1 and text.startswith(mark, at):
            break
        elif c == '"':
            quoted = True
        else:
            depth += (c in "{[") - (c in "}]")
        at += 1
    cut = at + len(mark)
    return text[:cut].encode(), text[cut:].encode()


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    sha256: str
    size: int
    members: int


class ManifestWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.header, self.expected = options["path"], json.loads(options["header"]), int(options["expected"])

    def write(self, rows: Iterator[Row]) -> Written | None:
        first = next(rows, None)
        if first is None and self.expected:
            return None  # a task without rows
        files, path = _files(self.path)
        temporary, sha, size, n, last = f"{path}.{uuid.uuid4().hex}.tmp", hashlib.sha256(), 0, 0, None
        head, tail = _frame(self.header)
        try:
            with files.open_output_stream(temporary) as out:

                def put(data: bytes) -> None:
                    nonlocal size
                    size += len(data)
                    if size > MOST_BYTES:
                        raise ValueError(f"a manifest has at most {MOST_BYTES} bytes")
                    sha.update(data)
                    out.write(data)

                put(head)
                row = first
                while row is not None:
                    if last is not None and not row["sample_id"] > last:
                        raise ValueError(f"members repeat or are out of order: {row['sample_id']}")
                    if n == self.expected:
                        raise ValueError(f"more members than {self.expected}")
                    put((b"," if n else b"") + row["member"].encode())
                    last, n, row = row["sample_id"], n + 1, next(rows, None)
                put(tail)
        except BaseException:
            files.delete_file(temporary)
            raise
        return Written(temporary, sha.hexdigest(), size, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _files(self.path)
        done = [m for m in messages if m is not None]
        if len(done) != 1 or done[0].members != self.expected:
            raise ValueError(f"{sum(m.members for m in done)} members instead of {self.expected}, or not in one task")
        m = done[0]
        described = json.dumps({"sha256": m.sha256, "size_bytes": m.size, "members": m.members}).encode()
        from pyarrow import fs

        if files.get_file_info(path).type != fs.FileType.NotFound:
            with files.open_input_stream(f"{path}.digest") as f:
                if f.read() != described:
                    raise ValueError(f"{path} holds another manifest")
            files.delete_file(m.temporary)
            return
        with files.open_output_stream(f"{path}.digest") as out:
            out.write(described)
        files.move(m.temporary, path)

    def abort(self, messages: list[Written | None]) -> None:
        """Spark calls this when a task or the commit has failed."""
        from pyarrow import fs

        files, _ = _files(self.path)
        for m in messages:
            if m is not None and files.get_file_info(m.temporary).type != fs.FileType.NotFound:
                files.delete_file(m.temporary)


class Json:
    """Values of a JSON text read chunk by chunk; what is held is one value and a chunk."""

    def __init__(self, stream):
        import codecs

        self.stream, self.decode, self.text, self.at, self.over = stream, codecs.getincrementaldecoder("utf-8")(), "", 0, False
        self.json = json.JSONDecoder()

    def more(self) -> bool:
        data = self.stream.read(CHUNK)
        self.over = not data
        self.text, self.at = self.text[self.at :] + self.decode.decode(data, final=self.over), 0
        return not self.over

    def char(self) -> str:
        while self.at >= len(self.text):
            if not self.more():
                raise ValueError("the manifest ends early")
        self.at += 1
        return self.text[self.at - 1]

    def expect(self, wanted: str) -> str:
        c = self.char()
        if c not in wanted:
            raise ValueError(f"{c!r} instead of one of {wanted!r}")
        return c

    def value(self):
        while True:
            try:
                found, end = self.json.raw_decode(self.text, self.at)
                if end < len(self.text) or self.over:
                    self.at = end
                    return found
            except ValueError:
                if self.over:
                    raise
            self.more()


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.identity = options["path"], json.loads(options.get("identity", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, path = _files(self.path)
        with files.open_input_stream(f"{path}.digest") as f:
            described = json.loads(f.read())
        sha, size = hashlib.sha256(), 0
        with files.open_input_stream(path) as f:
            while data := f.read(CHUNK):
                sha.update(data)
                size += len(data)
        if size != described["size_bytes"] or sha.hexdigest() != described["sha256"]:
            raise ValueError(f"{path} isn't what was written")
        with files.open_input_stream(path) as f:
            yield from self._members(Json(f), path)

    def _members(self, text: Json, path: str) -> Iterator[tuple]:
        header, last = {}, ""
        text.expect("{")
        sign = ","
        while sign == ",":
            key = text.value()
            text.expect(":")
            if key != "members":
                header[key] = text.value()
            else:
                text.expect("[")
                sign = text.char()
                text.at -= 1
                while sign != "]":
                    member = text.value()
                    if not member["sample_id"] > last:
                        raise ValueError(f"{path}: members repeat or are out of order")
                    last = member["sample_id"]
                    yield last, json.dumps(member, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                    sign = text.expect(",]")
                if text.text[text.at - 1 : text.at] != "]":
                    text.expect("]")
            sign = text.expect(",}")
        if any(header.get(k) != v for k, v in self.identity.items()):
            raise ValueError(f"{path}: the manifest of something else")


class ManifestSource(DataSource):
    """``quarry_manifest``: options path; for writing header (JSON) and expected (members); for reading identity (JSON of header fields)."""

    @classmethod
    def name(cls) -> str:
        return "quarry_manifest"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options)

    def writer(self, schema, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options)


def write_manifest(members: DataFrame, path: str, header: dict, expected: int) -> dict:
    """Write members (sample_id, member: canonical JSON) as one manifest and return its sha256, size_bytes and members.

    A wrong number of members or too many bytes are refused before anything
    is written. Writing the same again finds it there; another manifest at the
    same path is an error.
    """
    spark = members.sparkSession
    size = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("member") + 1), F.lit(0)).alias("bytes")).first()
    if size["n"] != expected:
        raise ValueError(f"{size['n']} members instead of {expected}")
    if sum(map(len, _frame(header))) + max(0, size["bytes"] - 1) > MOST_BYTES:
        raise ValueError(f"a manifest has at most {MOST_BYTES} bytes")
    spark.dataSource.register(ManifestSource)
    one = members.select("sample_id", "member").repartition(1).sortWithinPartitions("sample_id")
    one.write.format("quarry_manifest").options(path=path, header=json.dumps(header), expected=str(expected)).mode("append").save()
    files, at = _files(path)
    with files.open_input_stream(f"{at}.digest") as f:
        return json.loads(f.read())


def read_manifest(spark: SparkSession, path: str, identity: dict | None = None) -> DataFrame:
    """sample_id and member (canonical JSON) of a manifest whose bytes are those that were written and whose header has the fields of ``identity``."""
    spark.dataSource.register(ManifestSource)
    return spark.read.format("quarry_manifest").options(path=path, identity=json.dumps(identity or {})).load()


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.after = options["path"], ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the path are used to leave out folders and files; all are still applied by Spark."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo) and f.attribute == ("name",):
                self.after = max(self.after, f.value)
            yield f

    def _list(self, folder: str) -> list:
        from pyarrow import fs

        files, root = _files(self.root)
        return sorted(files.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"))), key=lambda i: i.path)

    def _may(self, name: str, folder: bool) -> bool:
        """Whether a name, or one below a folder, can be past the bound."""
        return name >= self.after or folder and (self.after.startswith(f"{name}/") or f"{name}/" > self.after)

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        below = [i.base_name for i in self._list("") if i.type == fs.FileType.Directory and self._may(i.base_name, True)]
        return [Folder("", False), *(Folder(n, True) for n in below)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        todo = [partition.path]
        while todo:
            folder = todo.pop()
            for i in self._list(folder):
                name = f"{folder}/{i.base_name}".lstrip("/")
                if i.type == fs.FileType.Directory and partition.deep and self._may(name, True):
                    todo.append(name)
                elif i.type == fs.FileType.File and self._may(name, False):
                    yield name, i.size, i.mtime.replace(tzinfo=None) if i.mtime else None


class ListingSource(DataSource):
    """``quarry_objects``: names below a folder (option path), with sizes and times of change; contents aren't read."""

    @classmethod
    def name(cls) -> str:
        return "quarry_objects"

    def schema(self) -> str:
        return "name string, bytes long, modified timestamp_ntz"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def listing_page(spark: SparkSession, root: str, after: str | None = None, limit: int = 100) -> tuple[list[Row], str | None]:
    """The 1 to 100 objects whose names follow ``after``, and the name to go on after (None: that was all); folders before it aren't listed."""
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 objects")
    spark.dataSource.register(ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("quarry_objects").option("path", root).load()
    rows = (found if after is None else found.filter(F.col("name") > after)).orderBy("name").limit(limit + 1).collect()
    return rows[:limit], rows[limit - 1]["name"] if len(rows) > limit else None

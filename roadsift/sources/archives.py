"""Archives as a data source: members of zip and tar files as rows, and rows as archives with a two-phase commit.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("path", "/shared/in/*.zip").load()
    rows.write.format("archive").option("path", "/shared/out").option("kind", "tar").mode("append").save()

A partition is a range of an archive's directory of bounded bytes; the task opens the
archive itself, so no member passes through the driver.  Archives are found through
``pyarrow.fs`` (local and mounted paths, and the stores it knows); they need seeking.

Members that would leave the target folder (absolute names, drives, ``..``), links and
devices are refused before anything is read.  Of volumes only complete zip and tar files
can be read; others are an error.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import re
import tarfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of members in a partition, about.
SPLIT_BYTES = 64 << 20
SCHEMA = "archive string, place long, member string, size long, content binary"
_KINDS = {".zip": "zip", ".tar": "tar", ".tar.gz": "tar", ".tgz": "tar"}
_OTHER = re.compile(r"\.(rar|7z|(7z|zip)\.\d+)$", re.IGNORECASE)
#: Names of members are as old as the zip format allows, so equal rows make equal archives.
OLDEST = (1980, 1, 1, 0, 0, 0)


class ArchiveError(ValueError):
    """An archive that cannot or must not be unpacked."""


def safe_name(name: str) -> str:
    """The name with forward slashes, if it stays below the folder it is unpacked to."""
    clean = name.replace("\\", "/")
    parts = clean.split("/")
    if clean.startswith("/") or re.match(r"[A-Za-z]:", clean) or ".." in parts or "\x00" in clean or not clean.strip("/"):
        raise ArchiveError(f"unsafe member name: {name!r}")
    return "/".join(p for p in parts if p not in ("", "."))


def _kind(path: str) -> str | None:
    low = path.lower()
    return next((kind for end, kind in _KINDS.items() if low.endswith(end)), None)


def _found(path: str) -> tuple[arrow_fs.FileSystem, list[str]]:
    """The archives of a folder, or that a pattern for the last part of the path fits, by name."""
    system, base = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)
    folder, _, pattern = base.rpartition("/")
    if not any(c in pattern for c in "*?["):
        info = system.get_file_info(base)
        if info.type == arrow_fs.FileType.File:
            return system, [base]
        folder, pattern = base, "*"
    names = [i.path for i in system.get_file_info(arrow_fs.FileSelector(folder)) if i.type == arrow_fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]
    if bad := [n for n in names if _OTHER.search(n)]:
        raise ArchiveError(f"only zip and tar archives can be read: {sorted(bad)[:3]}")
    return system, sorted(n for n in names if _kind(n))


def _members(file: Any, kind: str) -> Iterator[tuple[Any, str, int]]:
    """Entry, safe name and size of each file of an archive in its order."""
    if kind == "zip":
        for z in file.infolist():
            name = safe_name(z.filename)
            if (z.external_attr >> 28) == 0xA:  # a symbolic link by its Unix mode
                raise ArchiveError(f"a link: {z.filename!r}")
            if not z.is_dir():
                yield z, name, z.file_size
    else:
        for t in file:
            name = safe_name(t.name) if t.name.strip("./") else ""
            if not (t.isfile() or t.isdir()):
                raise ArchiveError(f"a link or device: {t.name!r}")
            if t.isfile():
                yield t, name, t.size


def _opened(stream: Any, kind: str) -> Any:
    try:
        return zipfile.ZipFile(stream) if kind == "zip" else tarfile.open(fileobj=stream)
    except (zipfile.BadZipFile, tarfile.TarError, pa.ArrowInvalid) as broken:  # the last: a file shorter than what is looked for
        raise ArchiveError(f"not a {kind} archive") from broken


@dataclass
class _Range(InputPartition):
    archive: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        system, archives = _found(self.path)
        out: list[InputPartition] = []
        for archive in archives:
            kind = _kind(archive)
            with system.open_input_file(archive) as stream, _opened(stream, kind) as file:
                start = place = filled = 0
                for _, _, size in _members(file, kind):
                    if filled and filled + size > self.split:
                        out.append(_Range(archive, start, place))
                        start, filled = place, 0
                    filled, place = filled + size, place + 1
                if place > start:
                    out.append(_Range(archive, start, place))
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:  # type: ignore[override]
        if not partition.archive:
            return
        system, _ = arrow_fs.FileSystem.from_uri(self.path) if "://" in self.path else (arrow_fs.LocalFileSystem(), "")
        kind = _kind(partition.archive)
        with system.open_input_file(partition.archive) as stream, _opened(stream, kind) as file:
            for place, (entry, name, size) in enumerate(_members(file, kind)):
                if place >= partition.stop:
                    return
                if place >= partition.start:
                    body = None
                    if self.content:
                        body = file.read(entry) if kind == "zip" else file.extractfile(entry).read()
                    yield partition.archive.rpartition("/")[2], place, name, size, body


@dataclass
class _Written(WriterCommitMessage):
    name: str
    members: int
    size: int
    sha256: str


class _Writer(DataSourceWriter):
    """Each task writes an archive into a hidden folder; the driver moves them into place only when all are there."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "zip")
        if self.kind not in ("zip", "tar"):
            raise ArchiveError(f"kind must be zip or tar, not {self.kind!r}")
        if missing := {"member", "content"} - set(schema.names):
            raise ArchiveError(f"columns are missing: {sorted(missing)}")
        self.job = uuid.uuid4().hex

    def _system(self) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(self.path) if "://" in self.path else (arrow_fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Any]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex[:8]}.{self.kind}"
        system, base = self._system()
        folder = f"{base}/.{self.job}"
        system.create_dir(folder, recursive=True)
        members: set[str] = set()
        with system.open_output_stream(f"{folder}/{name}") as raw:
            out = _Digested(raw)
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) if self.kind == "zip" else tarfile.open(fileobj=out, mode="w|") as file:
                for row in iterator:
                    member, body = safe_name(row["member"]), bytes(row["content"] or b"")
                    if member in members:
                        raise ArchiveError(f"two members are called {member!r}")
                    members.add(member)
                    if self.kind == "zip":
                        file.writestr(zipfile.ZipInfo(member, OLDEST), body)
                    else:
                        info = tarfile.TarInfo(member)
                        info.size = len(body)
                        file.addfile(info, io.BytesIO(body))
        return _Written(name, len(members), out.at, out.digest.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = self._system()
        done = [m for m in messages if isinstance(m, _Written) and m.members]
        for m in done:
            system.move(f"{base}/.{self.job}/{m.name}", f"{base}/{m.name}")
        body = json.dumps({"parts": [{"name": m.name, "members": m.members, "size": m.size, "sha256": m.sha256} for m in sorted(done, key=lambda m: m.name)]}, indent=1)
        with system.open_output_stream(f"{base}/manifest-{self.job[:8]}.json") as out:  # the last step: without it nothing was committed
            out.write(body.encode())
        self._clean(system, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*self._system())

    def _clean(self, system: arrow_fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/.{self.job}").type == arrow_fs.FileType.Directory:
            system.delete_dir(f"{base}/.{self.job}")


class _Digested(io.RawIOBase):
    """A stream that cannot seek and knows its length and digest."""

    def __init__(self, raw: Any):
        self.raw, self.at, self.digest = raw, 0, hashlib.sha256()

    def writable(self) -> bool:
        return True

    def write(self, data: Any) -> int:
        body = bytes(data)
        self.raw.write(body)
        self.at += len(body)
        self.digest.update(body)
        return len(body)

    def tell(self) -> int:
        return self.at


class ArchiveSource(DataSource):
    """Options: path; reading: content (false lists members only), splitbytes; writing: kind (zip or tar)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema)


def members(spark, path: str, content: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:  # type: ignore[no-untyped-def]
    """archive, place, member, size, content (null unless asked for) of all archives below a path."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("path", path).option("content", str(content).lower()).option("splitbytes", split_bytes).load()


def merged(listing: DataFrame) -> DataFrame:
    """archive, place, path, size of the files that stand after all data trees are laid over each other.

    A data tree is a folder ``data``, at the top of an archive or one below, that holds
    ``samples`` or a version folder ``v1.0-...``; paths count from it.  The last archive by
    name wins, and in it the last tree and member."""
    shape = r"^((?:[^/]+/)?data)/(.+)$"
    tree = listing.withColumns({"root": F.regexp_extract("member", shape, 1), "path": F.regexp_extract("member", shape, 2)}).filter("path <> ''")
    roots = tree.filter(F.col("path").rlike(r"^(samples/|v1\.0-[^/]*/)")).select("archive", "root").distinct()
    order = Window.partitionBy("path").orderBy(F.col("archive").desc(), F.col("root").desc(), F.col("place").desc())
    return tree.join(roots, ["archive", "root"], "left_semi").withColumn("n", F.row_number().over(order)).filter("n = 1").select("archive", "place", "path", "size")


def check_parts(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, fault (missing or damaged) of the parts of a manifest (name, sha256) against files (path, content)."""
    there = parts.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("own"))
    met = manifest.join(there, "name", "left")
    return met.select("name", F.when(F.col("own").isNull(), F.lit("missing")).when(F.col("own") != F.lower("sha256"), F.lit("damaged")).alias("fault")).filter("fault is not null")

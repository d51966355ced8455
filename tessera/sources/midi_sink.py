"""MIDI files from notes, track names changed inside files, and a sink that writes one file a row.

Tasks write the files of their rows into a folder of their own below the target; when all tasks have ended, these are moved
to their places, so a task that runs again or a job that fails leaves no file behind. Names that occur twice are refused
before anything is written. Places are what pyarrow's file systems know: local or shared folders, hdfs, s3, gs.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tessera.sources import midi

FILES = "name string, content binary"
STAGED = "_staged"


def tracks_of(notes: list[dict]) -> list[dict]:
    """Tracks as midi.written() takes them: by track, name and program; drums on their own channel, others in turn."""
    found: dict[tuple, dict] = {}
    for n in sorted(notes, key=lambda n: (n["track_idx"], n["t0"], n["pitch"])):
        key = (n["track_idx"], n["name"], n["program"], n["is_drum"])
        turn = sum(not k[3] for k in found) % (16 - 1)
        own = found.setdefault(key, {"name": n["name"] or "", "program": n["program"], "channel": midi.DRUMS if n["is_drum"] else turn + (turn >= midi.DRUMS), "notes": []})
        own["notes"].append((n["pitch"], n["velocity"], n["t0"], n["t1"]))
    return list(found.values())


def encoded(rows: DataFrame, tempo: float = 120.0) -> DataFrame:
    """FILES of (name, notes): a piece's notes, whatever they were read from, at one tempo in 1/960 seconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [midi.written(tracks_of(notes or []), tempo=tempo) for notes in batch.column("notes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "content"])

    return rows.select("name", "notes").mapInArrow(run, FILES)


def retitled(data: bytes, old: str, new: str, contains: bool = False) -> tuple[bytes, list[str]]:
    """The file with its tracks of that name (any case, trimmed; or containing it) under the new one, and their names
    before. All other bytes stay as they are."""
    old, out, at, changed = old.strip().lower(), bytearray(data[:14]), 14, []
    head = struct.unpack(">I", data[4:8])[0] + 8
    out, at = bytearray(data[:head]), head
    while at + 8 <= len(data):
        kind, length = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + length]
        at += 8 + length
        if kind == b"MTrk":
            src, done, own = midi.Bytes(body), 0, bytearray()
            status = 0
            while src.at < len(body):
                src.number()
                first = src.take(1)[0]
                if first == 0xFF:
                    meta, begin = src.take(1)[0], src.at
                    text = src.take(src.number())
                    name = text.decode("latin-1").strip("\x00").strip()
                    if meta == 0x03 and name and (old in name.lower() if contains else name.lower() == old):
                        changed.append(name)
                        fresh = new.encode("latin-1", "replace")
                        own += body[done:begin] + midi.variable(len(fresh)) + fresh
                        done = src.at
                elif first in (0xF0, 0xF7):
                    src.take(src.number())
                else:
                    status = first if first >= 0x80 else status
                    src.take((1 if status & 0xF0 in (0xC0, 0xD0) else 2) - (first < 0x80))
            body = bytes(own + body[done:])
        out += kind + struct.pack(">I", len(body)) + body
    return bytes(out) + data[at:], changed


def renamed(files: DataFrame, old: str, new: str, contains: bool = False) -> DataFrame:
    """path, name (the file's), content, changed (names of tracks before) of (path, content) of those files with a change;
    files that can't be read are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    midi.decoded(data or b"")
                    content, changed = retitled(data, old, new, contains)
                except (ValueError, IndexError, struct.error):
                    continue
                if changed:
                    rows.append((path, path.rsplit("/", 1)[1], content, changed))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.list_(pa.string())))], ["path", "name", "content", "changed"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary, changed array<string>")


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else self.path.replace("file:", "", 1))

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, root = self.place()
        folder = f"{root}/{STAGED}-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        for row in iterator:
            target = f"{folder}/{row.name}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target, compression=None) as out:
                out.write(bytes(row.content))
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self.place()
        for folder in [m.folder for m in messages if m]:
            for f in system.get_file_info(fs.FileSelector(folder, recursive=True)):
                if f.type == fs.FileType.File:
                    target = f"{root}/{f.path[len(folder) + 1 :]}"
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    system.move(f.path, target)
        self.clear(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear(*self.place())

    def clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{STAGED}-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGED}-{self.job}")


class Files(DataSource):
    """Sink of FILES: `df.write.format("files").mode("append").save(path)` writes each row's content under its name."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """A file below path for each row of (name, content); equal names are refused."""
    spark: SparkSession = rows.sparkSession
    again = rows.groupBy("name").count().where("count > 1").orderBy("name").first()
    if again:
        raise ValueError(f"several files would have the name {again['name']}")
    if rows.where(F.col("name").isNull() | F.col("name").rlike(r"(?:^|/)\.\.?(?:/|$)|^/")).limit(1).count():
        raise ValueError("a name is missing or leads out of the folder")
    spark.dataSource.register(Files)
    rows.select("name", F.coalesce("content", F.lit(b"")).alias("content")).write.format("files").mode("append").save(path)

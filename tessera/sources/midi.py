"""Standard MIDI files as notes and metadata: a decoder and an encoder after the public file specification.

Files come by the binaryFile source, one row a file, and are decoded in Python workers: the only code of this package's
evaluation side that isn't DataFrame expressions. A file that can't be read gives a row with its error.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "struct<track_idx: int, name: string, program: int, is_drum: boolean, pitch: int, velocity: int, t0: double, t1: double>"
SCHEMA = f"path string, notes array<{NOTE}>, end_time double, tempo double, ts_numerator int, beats array<double>, downbeats array<double>, error string"
DRUMS = 9


class Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """A variable-length number."""
        out = 0
        while True:
            b = self.take(1)[0]
            out = out << 7 | b & 0x7F
            if b < 0x80:
                return out


def events(track: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, data) of a track; meta events have status 0xFF and their type first in data."""
    src, tick, status = Bytes(track), 0, 0
    while src.at < len(track):
        tick += src.number()
        head = src.take(1)[0]
        if head == 0xFF:
            kind = src.take(1)
            yield tick, head, kind + src.take(src.number())
        elif head in (0xF0, 0xF7):
            src.take(src.number())
        else:
            if head >= 0x80:
                status, data = head, b""
            else:
                data = bytes([head])
            if status < 0x80:
                raise ValueError("data without a status")
            need = 1 if status & 0xF0 in (0xC0, 0xD0) else 2
            yield tick, status, data + src.take(need - len(data))


def decoded(data: bytes, with_notes: bool = True) -> dict:
    """A file's notes and metadata, or its metadata alone."""
    src = Bytes(data)
    if src.take(4) != b"MThd":
        raise ValueError("not a MIDI file")
    size = struct.unpack(">I", src.take(4))[0]
    _, n_tracks, division = struct.unpack(">HHH", src.take(size)[:6])
    if division & 0x8000 or not division:
        raise ValueError("time in frames isn't supported")
    tracks = []
    while len(tracks) < n_tracks and src.at < len(data):
        kind, length = src.take(4), struct.unpack(">I", src.take(4))[0]
        body = src.take(length)
        if kind == b"MTrk":
            tracks.append(list(events(body)))
    tempos = sorted({t: int.from_bytes(d[1:4], "big") for own in tracks for t, s, d in own if s == 0xFF and d[0] == 0x51}.items())
    signatures = sorted({t: (d[1], 1 << d[2]) for own in tracks for t, s, d in own if s == 0xFF and d[0] == 0x58}.items())
    marks, seconds, rates = [0], [0.0], [500_000]
    for t, micro in tempos:
        seconds.append(seconds[-1] + (t - marks[-1]) * rates[-1] / 1e6 / division)
        marks.append(t)
        rates.append(micro)

    def at(tick: int) -> float:
        k = bisect_right(marks, tick) - 1
        return seconds[k] + (tick - marks[k]) * rates[k] / 1e6 / division

    notes, last, order = [], 0, {}
    for k, own in enumerate(tracks):
        name, programs, open_ = "", defaultdict(int), defaultdict(list)
        for tick, status, body in own:
            last = max(last, tick)
            channel, kind = status & 0x0F, status & 0xF0
            if status == 0xFF:
                if body[0] == 0x03:
                    name = body[1:].decode("latin-1").strip("\x00")
            elif kind == 0xC0:
                programs[channel] = body[0]
            elif kind == 0x90 and body[1]:
                open_[channel, body[0]].append((tick, body[1], programs[channel]))
            elif kind in (0x80, 0x90):
                # a note off ends all notes of its pitch that began before; one that began at this tick goes on
                held = open_[channel, body[0]]
                for begin, velocity, program in [x for x in held if x[0] < tick]:
                    key = (k, channel, program)
                    notes.append((order.setdefault(key, len(order)), name, program, channel == DRUMS, body[0], velocity, at(begin), at(tick)))
                open_[channel, body[0]] = [x for x in held if x[0] >= tick]
        for (channel, pitch), held in open_.items():  # notes that nothing ends go on to the track's end
            for begin, velocity, program in held:
                if own and own[-1][0] > begin:
                    key = (k, channel, program)
                    notes.append((order.setdefault(key, len(order)), name, program, channel == DRUMS, pitch, velocity, at(begin), at(own[-1][0])))
    grid, downs, tick, beat, numerator, unit = [], [], 0.0, 0, 4, 4
    todo = list(signatures)
    while tick <= last:
        while todo and todo[0][0] <= tick:
            beat, (numerator, unit) = 0, todo.pop(0)[1]
        grid.append(at(int(tick)))
        if beat % max(numerator, 1) == 0:
            downs.append(grid[-1])
        beat += 1
        tick += division * 4 / max(unit, 1)
    return {
        "notes": [dict(zip(("track_idx", "name", "program", "is_drum", "pitch", "velocity", "t0", "t1"), n)) for n in sorted(notes, key=lambda n: (n[0], n[6], n[4]))] if with_notes else None,
        "end_time": max([n[7] for n in notes], default=0.0), "tempo": 60e6 / (tempos[0][1] if tempos else 500_000),
        "ts_numerator": signatures[0][1][0] if signatures else 4, "beats": grid, "downbeats": downs, "error": None,
    }


ERRORS = ("rows", "drop", "fail")


def reader(with_notes: bool, errors: str):
    """Decodes batches of (path, content); what can't be read gives a row with its error, none, or an exception."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        note = pa.struct([("track_idx", pa.int32()), ("name", pa.string()), ("program", pa.int32()), ("is_drum", pa.bool_()), ("pitch", pa.int32()), ("velocity", pa.int32()), ("t0", pa.float64()), ("t1", pa.float64())])
        kinds = {"notes": pa.list_(note), "end_time": pa.float64(), "tempo": pa.float64(), "ts_numerator": pa.int32(), "beats": pa.list_(pa.float64()), "downbeats": pa.list_(pa.float64()), "error": pa.string()}
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows.append({"path": path} | decoded(data or b"", with_notes))
                except (ValueError, IndexError, struct.error) as e:
                    if errors == "fail":
                        raise ValueError(f"{path}: {e}") from e
                    if errors == "rows":
                        rows.append({"path": path, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows], pa.string()), *[pa.array([r.get(k) for r in rows], kind) for k, kind in kinds.items()]], ["path", *kinds])

    return read


def contents(spark: SparkSession, path: str | list[str], pattern: str = "*.mid*", recursive: bool = False) -> DataFrame:
    """path, content of each file; small files share a partition, as Spark's readers pack them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", "content")


def files(spark: SparkSession, path: str | list[str], pattern: str = "*.mid*", recursive: bool = False, with_notes: bool = True, errors: str = "rows") -> DataFrame:
    """path, notes, end_time, tempo, ts_numerator, beats, downbeats, error of each file in a folder or in several.

    Without notes these are null, and no note leaves its worker. errors: one of ERRORS.
    """
    if errors not in ERRORS:
        raise ValueError(f"{errors}: not one of {', '.join(ERRORS)}")
    return contents(spark, path, pattern, recursive).mapInArrow(reader(with_notes, errors), SCHEMA)


def notes(decoded_files: DataFrame, **constants) -> DataFrame:
    """A row for each note, with its file and constant columns (such as side)."""
    rows = decoded_files.where("error is null").select("path", F.inline("notes"))
    return rows.withColumns({k: F.lit(v) for k, v in constants.items()}) if constants else rows


def variable(n: int) -> bytes:
    """A number of variable length."""
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def written(tracks: list[dict], division: int = 480, tempo: float = 120.0, numerator: int = 4) -> bytes:
    """A file of tracks {name, program, channel, notes: [(pitch, velocity, t0, t1)]}."""

    def chunk(timed: list[tuple[int, bytes]]) -> bytes:
        body, now = b"", 0
        for tick, data in sorted(timed, key=lambda x: x[0]):
            body += variable(tick - now) + data
            now = tick
        body += b"\x00\xff\x2f\x00"
        return b"MTrk" + struct.pack(">I", len(body)) + body

    tick = lambda t: round(t * division * tempo / 60)
    head = [(0, b"\xff\x51\x03" + round(60e6 / tempo).to_bytes(3, "big")), (0, bytes([0xFF, 0x58, 4, numerator, 2, 24, 8]))]
    out = [chunk(head)]
    for t in tracks:
        name, channel = t.get("name", "").encode("latin-1", "replace"), t.get("channel", 0)
        timed = [(0, b"\xff\x03" + variable(len(name)) + name), (0, bytes([0xC0 | channel, t.get("program", 0)]))]
        for pitch, velocity, t0, t1 in t["notes"]:
            timed += [(tick(t0), bytes([0x90 | channel, pitch, velocity])), (tick(t1), bytes([0x80 | channel, pitch, 0]))]
        out.append(chunk(timed))
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(out), division) + b"".join(out)

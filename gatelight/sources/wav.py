"""WAV files as a Spark data source, read and written.

`spark.dataSource.register(WavSource)`, then `spark.read.format("wav").load(folder)` has a row for each .wav
file below it: path, rate, channels, n (frames) and samples (mono, in -1..1). Without samples in the schema,
as in `.schema("path string, rate int, channels int, n long")`, only headers are read. The option `files`, patterns such
as `*/d1/*/mix.wav` apart by commas, picks paths from the listing, before any file is opened. (Filters aren't pushed: Spark
4.1 keeps what was pushed for later scans of the same DataFrame, which would then lack rows.)

Written rows (path, rate, samples) become one 16-bit file each; all of them appear when the job commits, with a
table of what was written (path, rate, n) in meta.csv, and none if it fails.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gatelight.sources.records import decode_wav, encode_wav

SCHEMA = "path string, rate int, channels int, n long, samples array<float>"
#: Bytes of files that one task reads, about.
PART_BYTES = 64 << 20
HEADER = 1 << 12


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, local or by URI, and the folder in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(stream, size: int) -> tuple[int, int, int]:
    """(rate, channels, frames) from the chunks before the samples; the samples themselves aren't read."""
    if stream.read(4) not in (b"RIFF", b"RIFX") or not stream.read(4) or stream.read(4) != b"WAVE":
        raise ValueError("not a WAV file")
    rate = channels = width = None
    while len(head := stream.read(8)) == 8:
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", stream.read(length)[:16])
            width = channels * ((bits + 7) // 8)
        elif name == b"data":
            if not width:
                break
            return rate, channels, min(length, size - stream.tell()) // width
        else:
            stream.seek(length + length % 2, 1)
    raise ValueError("a WAV file without format or data")


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], part_bytes: int, patterns: list[str]):
        self.root, self.columns, self.part_bytes, self.patterns = root, columns, part_bytes, patterns

    def _wanted(self, path: str) -> bool:
        return any(fnmatch.fnmatchcase(path, p) for p in self.patterns)

    def partitions(self) -> list[Files]:
        """Files in the order of their names, in tasks of about as many bytes; headers count a page each."""
        system, root = open_fs(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        listed = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".wav") and "/_" not in i.path[len(root) :] and self._wanted(i.path))
        out, size = [Files([])], 0
        for path, n in listed:
            cost = n if "samples" in self.columns else min(n, HEADER)
            if out[-1].paths and size + cost > self.part_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append((path, n))
            size += cost
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(self.root)
        kinds = {"path": pa.string(), "rate": pa.int32(), "channels": pa.int32(), "n": pa.int64(), "samples": pa.list_(pa.float32())}
        schema = pa.schema([(c, kinds[c]) for c in self.columns])
        for path, size in partition.paths:
            with system.open_input_file(path) as f:
                row = {"path": path}
                if set(self.columns) - {"path"}:
                    row["rate"], row["channels"], row["n"] = header(f, size)
                if "samples" in self.columns:
                    f.seek(0)
                    row["samples"] = decode_wav(f.read(), row["rate"])
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds[c]) for c in self.columns], schema=schema)


class WavWriter(DataSourceWriter):
    """Files are written under a hidden folder of the job, and moved when it commits."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, root = open_fs(self.root)
        out, task = [], uuid.uuid4().hex
        for i, r in enumerate(rows):
            name = r["path"].strip("/")
            if ".." in name.split("/") or not name.lower().endswith(".wav"):
                raise ValueError(f"{r['path']!r} is no name for a WAV file in a folder")
            x = np.asarray(r["samples"] if r["samples"] is not None else [], np.float64)
            part = f"{root}/_job-{self.job}/{task}-{i}.wav"
            system.create_dir(f"{root}/_job-{self.job}", recursive=True)
            with system.open_output_stream(part) as f:
                f.write(encode_wav(x, r["rate"] or 16000))
            out.append((part, name, r["rate"] or 16000, len(x)))
        return Written(out)

    def commit(self, messages: list[Written]) -> None:
        system, root = open_fs(self.root)
        files = sorted((name, part, rate, n) for m in messages if m is not None for part, name, rate, n in m.files)
        doubled = {a[0] for a, b in zip(files, files[1:]) if a[0] == b[0]}
        if doubled:
            self.abort(messages)
            raise ValueError(f"two rows for one file: {sorted(doubled)[0]}")
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if i.base_name != f"_job-{self.job}":
                    (system.delete_dir if i.type == fs.FileType.Directory else system.delete_file)(i.path)
        system.create_dir(root, recursive=True)
        for name, part, _, _ in files:
            system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            system.move(part, f"{root}/{name}")
        text = io.StringIO()
        csv.writer(text).writerows([("path", "rate", "n"), *((name, rate, n) for name, _, rate, n in files)])
        with system.open_output_stream(f"{root}/meta.csv") as f:
            f.write(text.getvalue().encode())
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_fs(self.root))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_job-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_job-{self.job}")


class WavSource(DataSource):
    """Options: path, part_bytes, files."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        known = [c.split()[0] for c in SCHEMA.split(", ")]
        if unknown := set(schema.fieldNames()) - set(known):
            raise ValueError(f"WAV files have no {', '.join(sorted(unknown))}")
        return WavReader(self.options["path"], schema.fieldNames(), int(self.options.get("part_bytes", PART_BYTES)), self.options.get("files", "*").split(","))

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], overwrite)

"""A data source of `<chrom>.bin` files: an int32 length, then that many values from position 1, one file for each chromosome.

Readers seek to ranges of a file, so a chromosome is read by as many tasks as it has ranges, and small files share a task. A file has one
writer, as it is one stream of bytes: it takes a chromosome's rows in order and holds a block of them. Files appear under their names when
the whole write has succeeded; those of failed or repeated tasks don't. Paths are opened by pyarrow.fs (local, s3, gs, hdfs).
"""

from __future__ import annotations

import contextlib
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Value types: of profiles (uint8 as in mappability files), and of sequences, which have no padding value at their end.
KINDS = {"double": np.dtype("<f8"), "uint8": np.dtype("u1"), "text": np.dtype("u1")}
PADDING = {"double": 1, "uint8": 1, "text": 0}
HEADER = 4
#: Bytes of a range of a file, and values that a task holds at once.
RANGE_BYTES, BLOCK_VALUES = 32 << 20, 1 << 20
#: Tasks that read, at most; where there are more ranges, a task reads several in turn.
MOST_TASKS = 1024

_RUNS = pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float64())])
_PIECES = pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("piece", pa.string())])
_LENGTHS = pa.schema([("chrom", pa.string()), ("l", pa.int64())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Ranges(InputPartition):
    """(path in the file system, chromosome, first value, number of values) of each range of a task."""

    ranges: list[tuple[str, str, int, int]]


def runs_of_values(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last index and value of the runs other than 0."""
    cuts = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts - 1, [len(x) - 1]))
    keep = x[starts] != 0
    return starts[keep], ends[keep], x[starts][keep]


def values_of_runs(sizes: np.ndarray, values: np.ndarray, limit: int = BLOCK_VALUES) -> Iterator[np.ndarray]:
    """Each value repeated by its size, in arrays of `limit` values at most."""
    upto = np.cumsum(sizes)
    for low in range(0, int(upto[-1]) if len(upto) else 0, limit):
        high = min(low + limit, int(upto[-1]))
        a, b = np.searchsorted(upto, low, "right"), np.searchsorted(upto, high, "left")
        yield np.repeat(values[a : b + 1], np.diff(np.concatenate(([low], upto[a:b], [high]))))


class BinaryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.scale = options["path"], options.get("kind", "double"), float(options.get("scale", 1.0))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        """Ranges by the sizes of the files alone; lengths are read by the tasks."""
        files, folder = opened(self.path)
        width = KINDS[self.kind].itemsize if self.kind in KINDS else 1
        out, held = [Ranges([])], 0
        for info in sorted(files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.path):
            if info.type != pafs.FileType.File or not info.path.endswith(".bin"):
                continue
            n = max(1, (info.size - HEADER) // width) if self.kind in KINDS else 1
            step = max(1, self.range_bytes // width)
            for first in range(0, n, step):
                size = min(step, n - first)
                if held and held + size > step:
                    out.append(Ranges([]))
                    held = 0
                out[-1].ranges.append((info.path, posixpath.basename(info.path)[:-4], first, size))
                held += size
        each = -(-len(out) // MOST_TASKS)
        return [Ranges([r for part in out[k : k + each] for r in part.ranges]) for k in range(0, len(out), each)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        for path, chrom, first, n in partition.ranges:
            with files.open_input_file(path) as f:
                length = struct.unpack("<i", f.read_at(HEADER, 0))[0]
                if self.kind not in KINDS:
                    yield pa.RecordBatch.from_pylist([{"chrom": chrom, "l": length}], _LENGTHS)
                    continue
                dtype = KINDS[self.kind]
                if self.kind == "text" and not length:
                    yield pa.RecordBatch.from_pylist([{"chrom": chrom, "start": 1, "piece": ""}], _PIECES)
                for at in range(first, min(first + n, length), BLOCK_VALUES):
                    size = min(BLOCK_VALUES, first + n - at, length - at)
                    data = f.read_at(size * dtype.itemsize, HEADER + at * dtype.itemsize)
                    if self.kind == "text":
                        yield pa.RecordBatch.from_pylist([{"chrom": chrom, "start": at + 1, "piece": data.decode("latin-1")}], _PIECES)
                        continue
                    x = np.frombuffer(data, dtype, len(data) // dtype.itemsize).astype(float) * self.scale
                    if len(x):
                        s, e, v = runs_of_values(x)
                        yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(s), pa.string()), pa.array(s + at + 1), pa.array(e + at + 1), pa.array(v)], schema=_RUNS)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are, and under which name they belong."""

    files: list[tuple[str, str]]


class BinaryWriter(DataSourceArrowWriter):
    """Takes rows (chrom, l, start, end, value), or (chrom, l, start, piece) for text: all of a chromosome in one partition, by start."""

    def __init__(self, options: dict):
        self.path, self.kind, self.run = options["path"], options.get("kind", "double"), f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = opened(self.path)
        own = f"{folder}/{self.run}/{uuid.uuid4().hex}"
        files.create_dir(own, recursive=True)
        dtype, made, now = KINDS[self.kind], [], None
        with contextlib.ExitStack() as stack:

            def finish() -> None:
                if now:
                    out, chrom, length, done = now
                    for x in values_of_runs(np.array([length - done + PADDING[self.kind]]), np.zeros(1, dtype)):
                        out.write(x.tobytes())
                    out.close()
                    made.append((f"{own}/{len(made)}", f"{folder}/{chrom}.bin"))

            for batch in iterator:
                for part in _by_chromosome(batch):
                    chrom, length = part.column("chrom")[0].as_py(), part.column("l")[0].as_py()
                    if now is None or now[1] != chrom:
                        finish()
                        out = stack.enter_context(files.open_output_stream(f"{own}/{len(made)}"))
                        out.write(struct.pack("<i", length))
                        now = [out, chrom, length, 0]
                    part = part.filter(pc.is_valid(part.column("start")))
                    now[3] = self._put(now[0], part, length, now[3], dtype)
            finish()
        return Written(made)

    def _put(self, out, part: pa.RecordBatch, length: int, done: int, dtype: np.dtype) -> int:
        """Write the rows' values and the gaps before them; gives the last position written."""
        if self.kind == "text":
            for start, piece in zip(part.column("start").to_pylist(), part.column("piece").to_pylist()):
                if start != done + 1:
                    raise ValueError(f"position {start} follows {done}")
                out.write(piece.encode("latin-1"))
                done += len(piece)
            return done
        start, end = np.maximum(part.column("start").to_numpy(), 1), np.minimum(part.column("end").to_numpy(), length)
        value = part.column("value").to_numpy()
        kept = start <= end
        start, end, value = start[kept], end[kept], value[kept]
        if len(start):
            gaps = start - np.concatenate(([done], end[:-1])) - 1
            if gaps.min() < 0:
                raise ValueError("runs of a profile overlap")
            sizes, values = np.stack([gaps, end - start + 1], 1).ravel(), np.stack([np.zeros(len(value)), value], 1).ravel()
            for x in values_of_runs(sizes, values):
                out.write(x.astype(dtype).tobytes())
            done = int(end[-1])
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = opened(self.path)
        for made, name in (f for m in messages if m for f in m.files):
            files.move(made, name)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = opened(self.path)
        with contextlib.suppress(OSError):
            files.delete_dir(f"{folder}/{self.run}")


def _by_chromosome(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    chroms, at = batch.column("chrom").to_pylist(), 0
    for k in range(1, len(chroms) + 1):
        if k == len(chroms) or chroms[k] != chroms[at]:
            yield batch.slice(at, k - at)
            at = k


class BinarySource(DataSource):
    """Options: path, kind (double, uint8, text; `length` reads the lengths alone), scale, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "terrane_binary"

    def schema(self) -> str:
        kind = self.options.get("kind", "double")
        return "chrom string, start long, end long, value double" if kind in ("double", "uint8") else "chrom string, start long, piece string" if kind == "text" else "chrom string, l long"

    def reader(self, schema) -> BinaryReader:
        return BinaryReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BinaryWriter:
        return BinaryWriter(dict(self.options))

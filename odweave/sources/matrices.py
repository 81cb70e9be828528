"""NumPy .npy matrices as a Spark data source, read by ranges of rows and written in parts.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load(path)                        # path, row, vector
    df.select("vector").write.format("npy").mode("append").save(path)

Paths are files or folders that pyarrow's file systems know (local, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a matrix in one task, in one Arrow batch, and in one written file.
PART, BATCH, FILE = 64 << 20, 4 << 20, 64 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _header(where: fs.FileSystem, name: str) -> tuple[int, int, np.dtype, int]:
    """Rows, columns, type and the place of the first row. Other than matrices of numbers in rows are errors."""
    with where.open_input_file(name) as f:
        version = np.lib.format.read_magic(f)
        shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(shape) != 2 or (by_columns and min(shape) > 1) or dtype.kind not in "fiub":
            raise ValueError(f"{name}: a matrix of numbers, stored by rows, is needed, not {dtype} of shape {shape}")
        return shape[0], shape[1], dtype, f.tell()


@dataclass
class Rows(InputPartition):
    """A range of rows of a file."""

    name: str
    first: int
    last: int
    columns: int
    dtype: str
    at: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.part = options["path"], int(options.get("partbytes", PART))

    def partitions(self) -> list[Rows]:
        where, root = _opened(self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [root] if info.is_file else sorted(i.path for i in where.get_file_info(fs.FileSelector(root)) if i.is_file and i.path.endswith(".npy"))
        found = []
        for name in names:
            rows, columns, dtype, at = _header(where, name)
            step = max(1, self.part // max(1, columns * dtype.itemsize))
            found += [Rows(name, a, min(rows, a + step), columns, dtype.str, at) for a in range(0, rows, step)]
        return found or [Rows("", 0, 0, 0, "<f8", 0)]

    def read(self, p: Rows) -> Iterator[pa.RecordBatch]:
        if p.first == p.last:
            return
        where, _ = _opened(self.path)
        dtype = np.dtype(p.dtype)
        width = p.columns * dtype.itemsize
        step = max(1, BATCH // max(1, p.columns * 8))
        with where.open_input_file(p.name) as f:
            for a in range(p.first, p.last, step):
                n = min(step, p.last - a)
                f.seek(p.at + a * width)
                raw = f.read(n * width)
                if len(raw) != n * width:
                    raise ValueError(f"{p.name}: {len(raw)} of {n * width} bytes at row {a}")
                flat = pa.array(np.frombuffer(raw, dtype).astype(np.float64))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.columns), flat)
                yield pa.RecordBatch.from_arrays([pa.array([p.name] * n), pa.array(np.arange(a, a + n)), vectors], ["path", "row", "vector"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NpyWriter(DataSourceArrowWriter):
    """Each task writes files of at most FILE bytes beside the target; once all are done they are moved there, so a lost task adds nothing to it. What a task writes after its job was aborted stays in a folder _writing-..., which is not read."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.dtype = options["path"], overwrite, options.get("dtype", "<f8")
        self.run = uuid.uuid4().hex[:12]

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        where, root = _opened(self.path)
        return where, root.rstrip("/"), f"{root.rstrip('/')}/_writing-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        where, _, folder = self._folders()
        names: list[str] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                where.create_dir(folder, recursive=True)
                name = f"part-{task.partitionId():05d}-{len(names):05d}-{self.run}-{task.taskAttemptId()}.npy"
                with where.open_output_stream(f"{folder}/{name}") as out:
                    a = np.concatenate(held)
                    np.lib.format.write_array_header_1_0(out, {"descr": a.dtype.str, "fortran_order": False, "shape": a.shape})
                    out.write(a.data)
                names.append(name)
            held, size = [], 0

        for b in iterator:
            col = b.column(b.schema.get_field_index("vector"))
            lengths = np.unique(col.value_lengths().to_numpy(zero_copy_only=False))
            flat = col.flatten()
            if not b.num_rows:
                continue
            if col.null_count or flat.null_count or len(lengths) != 1 or (held and held[0].shape[1] != lengths[0]):
                raise ValueError("a matrix takes vectors of one length without nulls")
            rows = flat.to_numpy(zero_copy_only=False).reshape(b.num_rows, int(lengths[0]))
            step = max(1, FILE // max(1, rows.shape[1] * np.dtype(self.dtype).itemsize))
            for a in range(0, len(rows), step):
                own = rows[a : a + step].astype(self.dtype)
                if size + own.nbytes > FILE:
                    flush()
                held.append(own)
                size += own.nbytes
        flush()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root, folder = self._folders()
        where.create_dir(root, recursive=True)
        old = [i.path for i in where.get_file_info(fs.FileSelector(root)) if i.is_file and i.path.endswith(".npy")] if self.overwrite else []
        for m in messages:
            for name in m.names if isinstance(m, Written) else ():
                where.move(f"{folder}/{name}", f"{root}/{name}")
        for name in old:
            where.delete_file(name)
        if where.get_file_info(folder).type == fs.FileType.Directory:
            where.delete_dir(folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, _, folder = self._folders()
        if where.get_file_info(folder).type == fs.FileType.Directory:
            where.delete_dir(folder)


class NpySource(DataSource):
    """Options: partbytes (of a task, read), dtype (written, little-endian float of eight bytes unless given)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, row long, vector array<double>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        if "vector" not in schema.fieldNames():
            raise ValueError("a matrix is written from a column named vector")
        return NpyWriter(self.options, overwrite)

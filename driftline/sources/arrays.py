"""Files of named arrays (npz) as a table: a Python data source with a partition for each file.

``spark.dataSource.register(ArrayFiles)``, then ``spark.read.format("arrays").option("columns", "X,y").load(folder)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows handed on at once.
ROWS = 10_000


def _open(path: str):
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, place


def array_files(path: str) -> list[str]:
    """The files below ``path`` (or itself) whose names end in .npz, in order."""
    system, place = _open(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz"))


def _loaded(path: str) -> np.lib.npyio.NpzFile:
    import io

    system, place = _open(path)
    with system.open_input_file(place) as file:
        return np.load(io.BytesIO(file.read()), allow_pickle=False)


def _kind(a: np.ndarray, name: str) -> str:
    kinds = {"f": "double", "i": "bigint", "u": "bigint", "b": "boolean", "U": "string"}
    if a.dtype.kind not in kinds or a.ndim == 0:
        raise ValueError(f"{name}: an array of {a.dtype} and {a.ndim} dimensions is no column")
    return "array<" * (a.ndim - 1) + kinds[a.dtype.kind] + ">" * (a.ndim - 1)


def checked(arrays: dict[str, np.ndarray], path: str, finite: bool) -> dict[str, np.ndarray]:
    """The arrays, if they have rows in common: as many each, and only finite numbers where that is asked for."""
    sizes = {name: a.shape[0] for name, a in arrays.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"{path}: arrays differ in rows: {sizes}")
    for name, a in arrays.items():
        if finite and a.dtype.kind == "f" and not np.isfinite(a).all():
            raise ValueError(f"{path}: {name} has values that are not finite")
    return arrays


@dataclass
class OneFile(InputPartition):
    path: str


class ArrayFiles(DataSource):
    """Options: ``path``; ``columns`` (names by comma, all if left out): only these arrays are unpacked; ``finite``
    ("true": numbers that aren't finite are an error). Rows are the arrays' first dimension, with ``file`` and ``row``."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _wanted(self) -> list[str] | None:
        return [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else None

    def schema(self) -> str:
        """Of the first file; every other file must fit it."""
        files = array_files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']}: no file of arrays")
        with _loaded(files[0]) as data:
            names = self._wanted() or list(data.files)
            if lacking := [n for n in names if n not in data.files]:
                raise ValueError(f"{files[0]}: lacks {lacking}")
            return ", ".join(["file string", "row bigint", *[f"`{n}` {_kind(data[n], n)}" for n in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options["path"], schema, self.options.get("finite", "false").lower() == "true")


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, finite: bool) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.finite, self.form = path, finite, to_arrow_schema(schema)

    def partitions(self) -> list[OneFile]:
        return [OneFile(f) for f in array_files(self.path)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.form if f.name not in ("file", "row")]
        with _loaded(partition.path) as data:
            if lacking := [n for n in names if n not in data.files]:
                raise ValueError(f"{partition.path}: lacks {lacking}")
            arrays = checked({n: data[n] for n in names}, partition.path, self.finite)
        n = len(next(iter(arrays.values()))) if arrays else 0
        for start in range(0, n, ROWS):
            end = min(n, start + ROWS)
            own = [pa.array([partition.path] * (end - start)), pa.array(np.arange(start, end))]
            own += [pa.array(a[start:end].tolist() if a.ndim > 1 else a[start:end], self.form.field(name).type) for name, a in arrays.items()]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(own, self.form)], schema=self.form)

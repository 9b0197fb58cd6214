"""A source of the parameters in checkpoint files: zip archives of a pickled table of names and one stored member per storage.

    spark.dataSource.register(Checkpoint)
    spark.read.format("checkpoint").load(path)                      name, shape, kind, data, as sources.weights has them
    spark.read.format("checkpoint").option("tile", 1024).load(path)  name, o, k, data: tiles, as operators.tiled takes them

The driver reads the archive's directory and the pickled table, never a
parameter; a partition is one parameter, or a band of rows of one, and its task
reads just that range of bytes.  Names wanted (option names, or a filter on name
where PUSHDOWN is set, with option pushdown) leave out the partitions of others.
The table is unpickled with names of tensors and storages only; anything else
in it is an error, so no code of a file is run.
"""

from __future__ import annotations

import pickle
import struct
import zipfile
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .png import filesystem

SCHEMA = "name string, shape array<int>, kind string, data binary"
TILES = "name string, o int, k int, data binary"
#: Kinds of storage by the names that the format gives them (fixed values); bfloat16 has no kind here, it becomes float32.
KINDS = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "BFloat16Storage": "bf16", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "|b1"}


#: Spark's setting for filters of such sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Tensor:
    """A parameter: its storage, and where in it the numbers lie."""

    key: str
    kind: str
    first: int
    shape: tuple[int, ...]
    stride: tuple[int, ...]

    @property
    def contiguous(self) -> bool:
        step = 1
        for size, stride in zip(reversed(self.shape), reversed(self.stride)):
            if size > 1 and stride != step:
                return False
            step *= size
        return True


class _Table(pickle.Unpickler):
    """Reads the table of a checkpoint; storages are (kind, key)."""

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return lambda storage, first, shape, stride, *_: Tensor(storage[1], storage[0], first, tuple(shape), tuple(stride))
        if (module, name) == ("torch._utils", "_rebuild_parameter"):
            return lambda tensor, *_: tensor
        if module == "torch" and name in KINDS:
            return KINDS[name]
        raise pickle.UnpicklingError(f"{module}.{name} in a checkpoint")

    def persistent_load(self, pid):
        _, kind, key, *_ = pid
        return kind, key


def _named(value, prefix: str = "") -> dict[str, Tensor]:
    """Tensors by their path in nested tables."""
    if isinstance(value, Tensor):
        return {prefix: value}
    if not isinstance(value, dict):
        return {}
    return {n: t for k, v in value.items() for n, t in _named(v, f"{prefix}.{k}" if prefix else str(k)).items()}


def table(path: str) -> dict[str, tuple[Tensor, int]]:
    """Each parameter with the place of its storage in the file."""
    fs, at = filesystem(path)
    with fs.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
        members = {i.filename.partition("/")[2]: i for i in archive.infolist()}
        found = _named(_Table(archive.open(members["data.pkl"])).load())
        places = {}
        for key in {t.key for t in found.values()}:
            member = members[f"data/{key}"]
            if member.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{path}: compressed storage {key}")
            file.seek(member.header_offset)
            name, extra = struct.unpack("<26xHH", file.read(30))
            places[key] = member.header_offset + 30 + name + extra
        return {n: (t, places[t.key]) for n, t in found.items()}


@dataclass
class Band(InputPartition):
    """Rows a to b of a parameter (all of it where it has fewer than two dimensions)."""

    name: str
    tensor: Tensor
    place: int
    a: int
    b: int


class CheckpointReader(DataSourceReader):
    def __init__(self, path: str, tile: int | None, names: set[str] | None):
        self.path, self.tile, self.names = path, tile, names

    def partitions(self):
        out = []
        for name, (tensor, place) in table(self.path).items():
            if self.names is not None and name not in self.names:
                continue
            if not self.tile:
                out.append(Band(name, tensor, place, 0, tensor.shape[0] if tensor.shape else 1))
            elif len(tensor.shape) > 1 and name.endswith(".weight"):
                out += [Band(name, tensor, place, a, min(a + self.tile, tensor.shape[0])) for a in range(0, tensor.shape[0], self.tile)]
        return out or [None]

    def read(self, partition):
        if partition is None:
            return
        values = self.values(partition)
        if not self.tile:
            yield partition.name, list(partition.tensor.shape), values.dtype.str, values.tobytes()
            return
        rows = values.reshape(len(values), -1).astype(np.float64)
        for k in range(0, rows.shape[1], self.tile):
            yield partition.name.removesuffix(".weight"), partition.a // self.tile, k // self.tile, np.ascontiguousarray(rows[:, k : k + self.tile]).tobytes()

    def values(self, band: Band) -> np.ndarray:
        """The numbers of a band, read as one range of bytes (of a transposed parameter: the range that holds them)."""
        t = band.tensor
        kind = np.dtype("<u2" if t.kind == "bf16" else t.kind)
        shape = (band.b - band.a, *t.shape[1:]) if t.shape else ()
        first = t.first + (band.a * t.stride[0] if t.shape else 0)
        if 0 in shape:
            return np.zeros(shape, np.float32 if t.kind == "bf16" else kind)
        span = 1 + sum((size - 1) * stride for size, stride in zip(shape, t.stride))
        fs, at = filesystem(self.path)
        with fs.open_input_file(at) as file:
            raw = np.frombuffer(file.read_at(span * kind.itemsize, band.place + first * kind.itemsize), kind)
        a = raw.reshape(shape) if t.contiguous else np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, shape, [s * kind.itemsize for s in t.stride]))
        return (a.astype(np.uint32) << 16).view(np.float32) if t.kind == "bf16" else a


class FilteredReader(CheckpointReader):
    """The same where Spark hands filters on."""

    def pushFilters(self, filters):
        for f in filters:
            of = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if of is not None and f.attribute == ("name",):
                of = {f"{n}.weight" for n in of} | of if self.tile else of
                self.names = of if self.names is None else self.names & of
            yield f  # names are compared again, which costs nothing


class Checkpoint(DataSource):
    @classmethod
    def name(cls) -> str:
        return "checkpoint"

    def schema(self) -> str:
        return TILES if self.options.get("tile") else SCHEMA

    def reader(self, schema) -> CheckpointReader:
        names = self.options.get("names")
        kind = FilteredReader if self.options.get("pushdown") == "true" else CheckpointReader
        return kind(self.options["path"], int(self.options["tile"]) if self.options.get("tile") else None, set(names.split(",")) if names else None)


def read(spark, path: str, tile: int | None = None, names: list[str] | None = None):
    """The parameters of a file, or tiles of its matrices; of some names only, if wanted."""
    spark.dataSource.register(Checkpoint)
    reader = spark.read.format("checkpoint").option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    reader = reader.option("tile", tile) if tile else reader
    reader = reader.option("names", ",".join(names)) if names is not None else reader
    return reader.load(path)

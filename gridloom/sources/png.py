"""A sink for images as PNG files.

Rows (path, height, width, channels, data; channels in B, G, R order, as
Spark's image source gives them) are each written to a file of that path under
the sink's folder.  A task writes into a staging folder of its own; when all
have ended, the driver moves the files to their places, so a failed or repeated
task leaves none behind.  The folder may be on any filesystem that pyarrow
reaches by its address.

    spark.dataSource.register(Png)
    rows.write.format("png").mode("append").save(folder)
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "path string, height int, width int, channels int, data binary"
#: PNG's colour types by number of channels (fixed values).
COLOURS = {1: 0, 3: 2, 4: 6}


def encode(data: bytes, height: int, width: int, channels: int) -> bytes:
    """An 8-bit PNG file of rows of pixels in gray, B G R or B G R A order."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels > 1:
        a = a[:, :, [2, 1, 0, 3][:channels]]
    lines = np.zeros((height, width * channels + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = a.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, COLOURS[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def filesystem(path: str):
    """(pyarrow filesystem, path in it) of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class PngWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = filesystem(self.path)
        folder = posixpath.join(root, f"_staging-{self.job}", str(TaskContext.get().taskAttemptId()))
        for row in iterator:
            name = posixpath.normpath(row["path"])
            if name.startswith(("/", "..")):
                raise ValueError(f"{row['path']}: outside the folder")
            at = posixpath.join(folder, name)
            fs.create_dir(posixpath.dirname(at), recursive=True)
            with fs.open_output_stream(at) as out:
                out.write(encode(bytes(row["data"]), row["height"], row["width"], row["channels"]))
        return Staged(folder)

    def commit(self, messages):
        from pyarrow.fs import FileSelector, FileType

        fs, root = filesystem(self.path)
        for message in messages:
            if message is None or fs.get_file_info(message.folder).type == FileType.NotFound:
                continue  # a task without rows
            for info in fs.get_file_info(FileSelector(message.folder, recursive=True)):
                if info.type == FileType.File:
                    to = posixpath.join(root, posixpath.relpath(info.path, message.folder))
                    fs.create_dir(posixpath.dirname(to), recursive=True)
                    fs.move(info.path, to)
        self._drop(fs, root)

    def abort(self, messages):
        self._drop(*filesystem(self.path))

    def _drop(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        staging = posixpath.join(root, f"_staging-{self.job}")
        if fs.get_file_info(staging).type != FileType.NotFound:
            fs.delete_dir(staging)


class Png(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PngWriter:
        if overwrite:
            raise ValueError("pictures are added to a folder: use mode append")
        return PngWriter(self.options["path"])


def write(rows, path: str) -> None:
    """Rows of SCHEMA as files under path."""
    rows.sparkSession.dataSource.register(Png)
    rows.select("path", "height", "width", "channels", "data").write.format("png").mode("append").save(path)

"""Pictures written and read back; checkpoint files read by ranges of bytes."""

import io
import os
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boxes, drawing, models, tiled
from gridloom.sources import checkpoint, png, results

IMAGE = "image_id long, height int, width int, channels int, data binary"


def picture(image_id, height, width, channels, seed=0):
    a = np.random.default_rng(seed + image_id).integers(0, 256, (height, width, channels)).astype(np.uint8)
    return (image_id, height, width, channels, bytearray(a.tobytes())), a


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_pictures_read_back(spark, tmp_path, channels):
    made = [picture(k, 3 + k, 5 + 2 * k, channels) for k in range(7)]
    rows = spark.createDataFrame([(f"of {k % 2}/{r[0]}.png", *r[1:]) for k, (r, _) in enumerate(made)], "path string, " + IMAGE.partition(", ")[2]).repartition(3)
    png.write(rows, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["of 0", "of 1"]
    got = {os.path.basename(r.origin): r for r in spark.read.format("image").load(str(tmp_path / "out/*")).select("image.*").collect()}
    for (image_id, *_), a in made:
        r = got[f"{image_id}.png"]
        assert (r.height, r.width) == a.shape[:2] and np.array_equal(np.frombuffer(r.data, np.uint8).reshape(a.shape[0], a.shape[1], -1), a)


def test_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", 1, 1, 1, bytearray(1)), ("../b.png", 1, 1, 1, bytearray(1))], png.SCHEMA)
    with pytest.raises(Exception, match="outside"):
        png.write(rows, str(tmp_path / "out"))
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]
    png.write(rows.limit(0), str(tmp_path / "out"))


def test_overlays_and_clippings(spark, tmp_path):
    rows, a = picture(3, 20, 30, 3)
    images = spark.createDataFrame([rows, picture(4, 5, 5, 3)[0]], IMAGE)
    found = [(3, 0, 4, 5, 12, 11, "Compo"), (3, 1, 25, 15, 40, 40, "Image"), (3, 2, 1, 1, 2, 2, "Compo"), (3, 3, -9, -9, -5, -5, "Compo")]
    frames = spark.createDataFrame(found, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long, category string")
    results.write_overlays(images, frames, str(tmp_path / "over"), (1, 2, 3))
    want = a.copy()
    for _, _, x1, y1, x2, y2, _ in found:
        for y in range(max(y1 - 1, 0), min(y2 + 1, 20)):
            for x in range(max(x1 - 1, 0), min(x2 + 1, 30)):
                if y <= y1 or y >= y2 - 1 or x <= x1 or x >= x2 - 1:
                    want[y, x] = (1, 2, 3)
    got = {os.path.basename(r.origin): r for r in spark.read.format("image").load(str(tmp_path / "over")).select("image.*").collect()}
    assert np.array_equal(np.frombuffer(got["3.png"].data, np.uint8).reshape(a.shape), want)
    assert bytes(got["4.png"].data) == bytes(picture(4, 5, 5, 3)[0][4])
    clips = drawing.clippings(images, boxes.numbered_clippings(frames), extra=("category", "nth"))
    results.write_pictures(clips, str(tmp_path / "clips"))
    files = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "clips") for d, _, names in os.walk(tmp_path / "clips") for f in names)
    assert files == ["Compo/1.png", "Compo/2.png", "Image/1.png"]
    one = spark.read.format("image").load(str(tmp_path / "clips/Image")).select("image.*").first()
    assert (one.height, one.width) == (7, 7) and np.array_equal(np.frombuffer(one.data, np.uint8).reshape(7, 7, 3), a[13:, 23:])


# checkpoints


class Storage:
    def __init__(self, key, kind, data):
        self.key, self.kind, self.data = key, kind, data


class Named:
    """A tensor, pickled by the call that rebuilds it."""

    def __init__(self, storage, first, shape, stride):
        self.args = (storage, first, shape, stride, False, {})

    def __reduce__(self):
        return sys.modules["torch._utils"]._rebuild_tensor_v2, self.args


def write_checkpoint(path, arrays, monkeypatch):
    """name -> array, or (array, kind): a file as the format has it; arrays that aren't contiguous share their base's storage."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    for name in checkpoint.KINDS:
        setattr(torch, name, type(name, (), {"__module__": "torch", "__qualname__": name}))

    def _rebuild_tensor_v2(*args):
        raise AssertionError

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = _rebuild_tensor_v2
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    kinds = {np.dtype(k): n for n, k in checkpoint.KINDS.items() if k != "bf16"}

    class Writer(pickle.Pickler):
        def persistent_id(self, obj):
            return ("storage", getattr(torch, obj.kind), obj.key, "cpu", len(obj.data)) if isinstance(obj, Storage) else None

    storages, table = [], {}
    for name, a in arrays.items():
        a, kind = a if isinstance(a, tuple) else (a, kinds[a.dtype])
        base = a if a.flags.c_contiguous else a.base
        storages.append(Storage(str(len(storages)), kind, base.tobytes()))
        first = (a.__array_interface__["data"][0] - base.__array_interface__["data"][0]) // a.itemsize
        at = table
        *outer, last = name.split("/")
        for part in outer:
            at = at.setdefault(part, {})
        at[last] = Named(storages[-1], first, a.shape, tuple(s // a.itemsize for s in a.strides))
    body = io.BytesIO()
    Writer(body, protocol=2).dump(table)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("model/data.pkl", body.getvalue())
        for s in storages:
            z.writestr(f"model/data/{s.key}", s.data)


def test_checkpoint(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    whole = rng.standard_normal((9, 7))
    arrays = {"a.weight": rng.standard_normal((5, 12)).astype("<f4"), "a.bias": rng.standard_normal(5).astype("<f2"), "turned.weight": whole.T, "part.weight": whole[2:5, 1:4], "n": np.array(7), "none": np.zeros((0, 3)), "in/side": np.arange(4, dtype="<i4"), "half.weight": (np.array([[0x3F80, 0xC000]], "<u2"), "BFloat16Storage")}
    path = str(tmp_path / "model.bin")
    write_checkpoint(path, arrays, monkeypatch)
    got = {r.name: np.frombuffer(r.data, r.kind).reshape(r.shape) for r in checkpoint.read(spark, path).collect()}
    assert got.keys() == {n.replace("/", ".") for n in arrays}
    for name, a in arrays.items():
        want = np.array([[1.0, -2.0]]) if name.startswith("half") else a
        assert np.array_equal(got[name.replace("/", ".")], want), name
    some = checkpoint.read(spark, path, names=["a.bias", "n"])
    assert {r.name for r in some.collect()} == {"a.bias", "n"} and some.rdd.getNumPartitions() == 2
    tiles = {(r.name, r.o, r.k): np.frombuffer(r.data).reshape(-1, min(4, {"a": 12, "turned": 9, "part": 3, "half": 2}[r.name] - 4 * r.k)) for r in checkpoint.read(spark, path, tile=4).collect()}
    assert np.array_equal(tiles["turned", 1, 2], whole.T[4:, 8:]) and np.array_equal(tiles["a", 0, 1], arrays["a.weight"][:4, 4:8])
    spark.conf.set(checkpoint.PUSHDOWN, "true")
    try:
        pushed = checkpoint.read(spark, path).filter(F.col("name").isin("a.bias", "a.weight"))
        assert {r.name for r in pushed.collect()} == {"a.bias", "a.weight"} and pushed.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset(checkpoint.PUSHDOWN)


def test_no_code_of_a_checkpoint_is_run(tmp_path):
    class Evil:
        def __reduce__(self):
            return os.system, ("true",)

    path = str(tmp_path / "evil.bin")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("m/data.pkl", pickle.dumps({"a": Evil()}))
    with pytest.raises(pickle.UnpicklingError):
        checkpoint.table(path)


def test_decoder_straight_from_a_checkpoint(spark, tmp_path, monkeypatch):
    config = models.FuserConfig(dim=8, heads=2, kv_heads=1, mlp=12, layers=1)
    path = str(tmp_path / "fuser.bin")
    write_checkpoint(path, {f"{n}.weight": np.ascontiguousarray(config.parameters(f"{n}.weight", *s)) for n, s in tiled.shapes_of(config).items()}, monkeypatch)
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(0, b, s, rng.standard_normal(8).tolist()) for b in range(3) for s in range(3)], "image_id long, box_idx long, slot int, vec array<double>")
    got = {r.box_idx: r.vec for r in tiled.fuse_triples(rows, config, checkpoint.read(spark, path, tile=5), tile=5).collect()}
    for r in models.fuse_triples(rows, config).collect():
        np.testing.assert_allclose(got[r.box_idx], r.vec, rtol=1e-9)

import struct
import zlib

import numpy as np
import pytest

from gridloom.operators import kernels, pixels
from gridloom.plans import detect, fixtures
from gridloom.sources import images, results


def png(path, rgb):
    """Write an RGB array as a PNG."""
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    tiny = np.zeros((4, 6, 3), int)
    tiny[1, 2] = (200, 100, 10)
    png(d / "tiny.png", tiny)
    ui = np.full((200, 300, 3), 240)
    ui[30:80, 20:110] = 20
    ui[30:80, 180:260] = 90
    png(d / "ui.png", ui)
    (d / "no.png").write_bytes(b"not an image")
    return d


def test_pixels(spark, folder):
    found = images.read(spark, str(folder))
    assert found.count() == 2
    tiny = images.pixels(found.filter("height = 4"))
    assert tiny.count() == 24
    r = tiny.filter("y = 1 AND x = 2").first()
    assert (r.b, r.g, r.r) == (10, 100, 200)
    assert pixels.gray(tiny).filter("y = 1 AND x = 2").first().v == round(0.299 * 200 + 0.587 * 100 + 0.114 * 10)


def test_detect(spark, folder):
    found = images.read(spark, str(folder))
    compos = detect.detect_components(found).collect()
    assert [r.box_id for r in compos] == list(range(1, len(compos) + 1)) and len(compos) == 2
    boxes = detect.detect(found).collect()
    assert len(boxes) == 2 and all(0 <= r.x1 < r.x2 < 1 and 0 <= r.y1 < r.y2 < 1 for r in boxes)
    assert {round(r.x1 * 300) // 10 for r in boxes} <= {1, 2, 17, 18}
    blank = np.full((50, 50, 3), 7, np.uint8)
    assert detect.components(blank) == [] and detect.boxes(blank) == []


def test_stream(spark, folder, tmp_path):
    from gridloom.streaming import images as streaming

    query = streaming.stream(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = detect.detect(images.read(spark, str(folder)))
    assert sorted(map(tuple, got.drop("image_id").collect())) == sorted(map(tuple, want.drop("image_id").collect()))


def test_results(spark, tmp_path):
    rows = [(1, 2, "Compo", 5, 6, 9, 12), (1, 1, "Block", 0, 0, 50, 60), (2, 1, "Compo", 1, 1, 4, 4)]
    boxes = spark.createDataFrame(rows, "image_id long, box_id long, category string, x1 long, y1 long, x2 long, y2 long")
    documents = results.to_documents(boxes, 800, 600)
    back = sorted((r.image_id, r.id, r.category, r.column_min, r.row_min, r.column_max, r.row_max) for r in results.from_documents(documents).collect())
    assert back == sorted(rows)
    assert documents.filter("image_id = 1").first().document.startswith('{"img_shape":[600,800,3],"compos":[{"id":1')
    results.write(documents, str(tmp_path / "json"))
    results.write_csv(boxes, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    results.write_clippings(spark.createDataFrame([("Compo", 1, 1, 0, 0, 255)], "category string, image_id int, box_id int, y int, x int, v int"), str(tmp_path / "clips"))
    assert (tmp_path / "clips" / "category=Compo").is_dir()


def between(a, w, h):
    """Each new pixel's centre in the old image, and the mean of the four around it by nearness, clamped at the borders."""
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            cy, cx = ((k + 0.5) * old / new - 0.5 for k, old, new in ((y, len(a), h), (x, a.shape[1], w)))
            cy, cx = min(max(cy, 0), len(a) - 1), min(max(cx, 0), a.shape[1] - 1)
            y0, x0 = int(cy), int(cx)
            y1, x1 = min(y0 + 1, len(a) - 1), min(x0 + 1, a.shape[1] - 1)
            fy, fx = cy - y0, cx - x0
            out[y, x] = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    return out


def test_resize(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (4, 6))
    df = spark.createDataFrame([(1, y, x, int(a[y, x])) for y in range(4) for x in range(6)], "image_id long, y long, x long, v long")
    for to in (2, 3, 4, 7):
        w, h = images.resized(6, 4, to)
        got = {(r.y, r.x): r.v for r in images.resize(df, 6, 4, to).collect()}
        made = kernels.resize(a.astype(np.uint8), w, h)
        assert got == {(y, x): made[y, x] for y in range(h) for x in range(w)}
        assert np.abs(made - between(a, w, h)).max() <= 1
    assert (kernels.resize(a.astype(np.uint8), 6, 4) == a).all()
    colour = rng.integers(0, 256, (9, 5, 3)).astype(np.uint8)
    assert all((kernels.resize(colour, 8, 4)[:, :, k] == kernels.resize(colour[:, :, k], 8, 4)).all() for k in range(3))
    assert (kernels.resize(np.full((7, 3), 255, np.uint8), 11, 20) == 255).all()


def test_median(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    for size in (1, 3, 5, 7, 31):
        reach, h, w = size // 2, *a.shape
        want = [[sorted(int(a[min(max(y + i, 0), h - 1), min(max(x + j, 0), w - 1)]) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))[size * size // 2] for x in range(w)] for y in range(h)]
        assert kernels.median(a, size).tolist() == want
        df = spark.createDataFrame([(1, y, x, int(a[y, x])) for y in range(h) for x in range(w)], "image_id long, y long, x long, v long")
        got = {(r.y, r.x): r.v for r in pixels.median(df, size, tile=4).collect()}
        assert got == {(y, x): want[y][x] for y in range(h) for x in range(w)}


def test_medians_of_many_levels():
    a = np.random.default_rng(4).permutation(50 * 60).reshape(50, 60)  # over 1024 levels, and the same folded to 250
    for v in (a, a // 12):
        padded = np.pad(v, 4, mode="edge")
        assert all(kernels.median(v, 9)[y, x] == np.sort(padded[y : y + 9, x : x + 9].ravel())[40] for y in range(50) for x in range(60))


def test_prepared_images(spark, folder):
    ready = images.read(spark, str(folder), resize_height=100, kernel_size=3).filter("width = 150").first()
    assert (ready.height, ready.width, len(ready.data)) == (100, 150, 100 * 150 * 3)
    whole = images.read(spark, str(folder)).filter("height = 200").first()
    a = images.array(whole.data, 200, 300, 3)
    assert (images.array(ready.data, 100, 150, 3) == kernels.resize(kernels.median(a, 3), 150, 100)).all()


def test_fixture_constants():
    assert fixtures.SIDE == 32

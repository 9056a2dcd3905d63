from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.sources import images, tiles


def tiff(pages: list[np.ndarray], shape=None, big=False, order="<", deflate=False, predictor=1, planar=1, strip=3) -> bytes:
    """A TIFF of pages (height, width, samples), in tiles of shape or strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 0) if big else (42, 0))))
    link, place = (8, "Q") if big else (4, "I")
    for page in pages:
        h, w, n = page.shape
        own = shape or (strip, w)
        blobs = []
        for p in range(n if planar == 2 else 1):
            held = page[:, :, p : p + 1] if planar == 2 else page
            for y in range(0, h, own[0]):
                for x in range(0, w, own[1]):
                    part = held[y : y + own[0], x : x + own[1]]
                    if shape:
                        part = np.pad(part, ((0, own[0] - part.shape[0]), (0, own[1] - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                    raw = np.ascontiguousarray(part.astype(page.dtype.newbyteorder(order))).tobytes()
                    blobs.append(zlib.compress(raw) if deflate else raw)
        offsets = []
        for b in blobs:
            offsets.append(len(out))
            out += b
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [page.dtype.itemsize * 8] * n), (259, 3, [8 if deflate else 1]), (277, 3, [n]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind] * n)]
        entries += [(322, 3, [own[1]]), (323, 3, [own[0]]), (324, 4, offsets), (325, 4, [len(b) for b in blobs])] if shape else [(273, 4, offsets), (278, 3, [own[0]]), (279, 4, [len(b) for b in blobs])]
        packed = []
        for tag, k, values in sorted(entries):
            raw = struct.pack(order + {3: "H", 4: "I"}[k] * len(values), *values)
            if len(raw) > struct.calcsize(place):
                at = len(out)
                out += raw
                raw = struct.pack(order + place, at)
            packed.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, k, len(values)) + raw.ljust(struct.calcsize(place), b"\0"))
        struct.pack_into(order + place, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(packed)) + b"".join(packed)
        link = len(out)
        out += struct.pack(order + place, 0)
    return bytes(out)


def whole(df, shape) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.channel, r.y : r.y + r.height, r.x : r.x + r.width] = np.array(r["values"]).reshape(r.height, r.width)
    return out


@pytest.mark.parametrize("how", [{}, {"shape": (16, 16)}, {"shape": (16, 32), "big": True, "deflate": True, "predictor": 2}, {"order": ">", "deflate": True, "strip": 7}, {"planar": 2, "shape": (16, 16)}])
def test_tiff(spark, tmp_path, how):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 60_000, (37, 45, 2)).astype(np.uint16) for _ in range(2)]
    path = tmp_path / "a.tif"
    path.write_bytes(tiff(pages, **how))
    want = np.concatenate([np.moveaxis(p, 2, 0) for p in pages])
    assert np.array_equal(whole(tiles.read_image(spark, str(path)), (4, 37, 45)), want)
    part = tiles.read_image(spark, str(path), region=(10, 5, 20, 9), channels=[1, 3])
    got = whole(part, (4, 37, 45))
    assert np.array_equal(got[[1, 3], 5:14, 10:30], want[[1, 3], 5:14, 10:30]) and np.isnan(got[[0, 2]]).all() and np.isfinite(got).sum() == 2 * 9 * 20


def test_segments_are_pruned(tmp_path):
    page = np.arange(64 * 64, dtype=np.float32).reshape(64, 64, 1)
    path = tmp_path / "b.tiff"
    path.write_bytes(tiff([page, page, page[:32, :32]], shape=(16, 16)))
    assert tiles.describe(str(path)) == {"height": 64, "width": 64, "channels": 2, "dtype": "<f4", "levels": [1.0, 2.0], "description": ""}
    made = lambda **o: [s for b in tiles.TileReader({"path": str(path)} | o).partitions() for s in b.segments]
    assert len(made()) == 32 and len(made(region="0,0,17,1")) == 4 and len(made(region="0,0,17,1", channels="1")) == 2 and len(made(level="1")) == 4
    reader = tiles.TileReader({"path": str(path), "batch": "1"})
    list(reader.pushFilters([tiles.EqualTo(("channel",), 1), tiles.In(("row",), (0, 3))]))
    assert len(reader.partitions()) == 8


def test_array_files(spark, tmp_path):
    a = np.random.default_rng(4).normal(size=(2, 3, 300, 20))
    np.save(tmp_path / "a.npy", a)
    got = whole(tiles.read_image(spark, str(tmp_path / "a.npy"), axes="TCYX"), (3, 300, 20))
    assert np.array_equal(got, a[0])
    part = tiles.read_image(spark, str(tmp_path / "a.npy"), axes="TCYX", region=(2, 250, 5, 20), channels=[2])
    assert np.array_equal(whole(part, (3, 300, 20))[2, 250:270, 2:7], a[0, 2, 250:270, 2:7]) and part.count() == 2


def test_encoded_files(spark, tmp_path):
    a = np.arange(3 * 50 * 70).reshape(3, 50, 70).astype(np.uint16)
    (tmp_path / "e.tif").write_bytes(tiles.encode_tiff(a, 32, "about"))
    assert np.array_equal(whole(tiles.read_image(spark, str(tmp_path / "e.tif")), a.shape), a) and tiles.describe(str(tmp_path / "e.tif"))["description"] == "about"


def test_filters_reach_the_source(spark, tmp_path):
    page = np.arange(64 * 64, dtype=np.int16).reshape(64, 64, 1)
    path = tmp_path / "c.tif"
    path.write_bytes(tiff([page, page], shape=(16, 16)))
    df = tiles.read_image(spark, str(path), batch=1).where("channel = 1 and row = 2")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 4


def test_other_codecs_are_refused(tmp_path):
    path = tmp_path / "d.tif"
    raw = bytearray(tiff([np.zeros((4, 4, 1), np.uint8)]))
    at = raw.find(struct.pack("<HHI", 259, 3, 1))
    struct.pack_into("<H", raw, at + 8, 5)
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="compression"):
        tiles.TileReader({"path": str(path)}).partitions()


@pytest.mark.parametrize("zipped", [False, True])
def test_zarr(spark, tmp_path, zipped):
    a = np.random.default_rng(2).integers(0, 255, (2, 3, 30, 41)).astype(np.uint8)  # T, C, Y, X
    root = tmp_path / "i.zarr"
    for level, step in enumerate((1, 2)):
        own = a[:, :, ::step, ::step]
        folder = root / str(level)
        folder.mkdir(parents=True)
        (folder / ".zarray").write_text(json.dumps({"shape": own.shape, "chunks": [1, 2, 16, 16], "dtype": "|u1", "compressor": {"id": "zlib", "level": 1} if zipped else None, "filters": None, "order": "C", "fill_value": 7, "zarr_format": 2}))
        for c in range(2):
            for y in range(0, own.shape[2], 16):
                for x in range(0, own.shape[3], 16):
                    if (level, c, y, x) == (0, 1, 16, 32):
                        continue  # a chunk that isn't stored
                    part = own[:1, 2 * c : 2 * c + 2, y : y + 16, x : x + 16]
                    part = np.pad(part, [(0, s - k) for s, k in zip((1, 2, 16, 16), part.shape, strict=True)])
                    (folder / f"0.{c}.{y // 16}.{x // 16}").write_bytes(zlib.compress(part.tobytes()) if zipped else part.tobytes())
    (root / ".zattrs").write_text(json.dumps({"multiscales": [{"axes": [{"name": n} for n in "tcyx"], "datasets": [{"path": "0"}, {"path": "1"}]}]}))
    about = tiles.describe(str(root))
    assert (about["height"], about["width"], about["channels"], about["dtype"]) == (30, 41, 3, "|u1") and len(about["levels"]) == 2
    want = a[0].astype(float)
    want[2, 16:, 32:] = 7
    assert np.array_equal(whole(tiles.read_image(spark, str(root)), (3, 30, 41)), want)
    assert np.array_equal(whole(tiles.read_image(spark, str(root), level=1), (3, 15, 21)), a[0, :, ::2, ::2])
    assert images.pixels(tiles.read_image(spark, str(root), region=(3, 4, 2, 2), channels=[0])).agg(F.sum("value")).first()[0] == a[0, 0, 4:6, 3:5].sum()

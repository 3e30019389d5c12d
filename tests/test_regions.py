"""Windows of TIFF pages against the image that was written."""

import struct
import zlib

import numpy as np
import pytest

from tesserae.sources import regions


def packed_lzw(data: bytes) -> bytes:
    """The plainest stream: a clear before every 200 bytes, so codes stay 9 bits wide."""
    codes = []
    for k in range(0, len(data), 200):
        codes += [256, *data[k : k + 200]]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packed_runs(data: bytes) -> bytes:
    return b"".join(bytes((len(data[k : k + 100]) - 1,)) + data[k : k + 100] for k in range(0, len(data), 100)) + b"\x80"


PACK = {1: bytes, 5: packed_lzw, 8: zlib.compress, 32773: packed_runs}


def write(path, image, packing, tile=None, predictor=1):
    height, width, samples = image.shape
    blocks = []
    if tile:
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                block = np.zeros((tile, tile, samples), np.uint8)
                part = image[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        blocks = [image[y : y + 7] for y in range(0, height, 7)]
    if predictor == 2:
        blocks = [np.diff(b.astype(np.int16), axis=1, prepend=0).astype(np.uint8) for b in blocks]
    data = [PACK[packing](b.tobytes()) for b in blocks]
    at, offsets = 8, []
    for d in data:
        offsets.append(at)
        at += len(d)
    lists, extra = [], b""

    def put(tag, kind, values):
        nonlocal extra
        raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            where, extra = at + len(extra), extra + raw
            raw = struct.pack("<I", where)
        lists.append((tag, struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")))

    for tag, kind, values in (
        (256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [packing]), (277, 3, [samples]), (317, 3, [predictor]),
        *(((322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, [len(d) for d in data])) if tile else ((273, 4, offsets), (278, 4, [7]), (279, 4, [len(d) for d in data]))),
    ):
        put(tag, kind, values)
    block = struct.pack("<H", len(lists)) + b"".join(e for _, e in sorted(lists)) + struct.pack("<I", 0)
    path.write_bytes(b"II*\0" + struct.pack("<I", at + len(extra)) + b"".join(data) + extra + block)


@pytest.mark.parametrize("packing", sorted(PACK))
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("samples", [1, 3, 4])
def test_windows_equal_the_image(tmp_path, packing, tile, samples):
    image = np.random.default_rng(packing).integers(0, 256, (37, 45, samples), dtype=np.uint8)
    for predictor in (1, 2):
        write(tmp_path / "a.tif", image, packing, tile, predictor)
        whole = np.zeros((60, 70, 3), np.uint8)
        whole[10:47, 12:57] = np.repeat(image, 3, axis=2) if samples == 1 else image[..., :3]
        for x, y, w, h in ((0, 0, 45, 37), (5, 9, 20, 11), (-12, -10, 70, 60), (40, 30, 18, 20), (100, 100, 4, 4)):
            with open(tmp_path / "a.tif", "rb") as data:
                got = regions.read(data, 0, x, y, w, h)
            want = np.zeros((h, w, 3), np.uint8)
            part = whole[max(0, y + 10) : max(0, y + 10 + h), max(0, x + 12) : max(0, x + 12 + w)]
            want[: part.shape[0], : part.shape[1]] = part
            assert (got == want).all()


def test_regions_of_files(spark, tmp_path):
    image = np.arange(30 * 40 * 3, dtype=np.uint8).reshape(30, 40, 3)
    write(tmp_path / "a.tif", image, 8, 16)
    wanted = spark.createDataFrame([(str(tmp_path / "a.tif"), 0, 3, 4, 10, 6), (str(tmp_path / "none.tif"), 0, 0, 0, 2, 2), (str(tmp_path / "a.tif"), 5, 0, 0, 2, 2)], "path string, page int, x int, y int, width int, height int")
    rows = {(r.path[-5], r.page): r for r in regions.regions(wanted).collect()}
    assert np.frombuffer(rows["a", 0].rgb, np.uint8).reshape(6, 10, 3).tolist() == image[4:10, 3:13].tolist()
    assert rows["e", 0].rgb is None and rows["e", 0].error and rows["a", 5].error

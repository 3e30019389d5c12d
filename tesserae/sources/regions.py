"""Windows of pixels out of TIFF pages: only the tiles or strips that a window meets are read.

Pages of 8-bit grey or colour, tiled or in strips, stored plainly or packed by Deflate, LZW or
PackBits, with or without horizontal prediction. Other packings (JPEG among them) need a codec that
isn't here and are told as an error of the row, as is a file that can't be read. Files are opened
where the executors run, so they must lie where these can open them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesserae.session import ship
from tesserae.sources import tiff

SCHEMA = "path string, page int, x int, y int, width int, height int, rgb binary, error string"


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    out, table, size, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        while bits >= size:
            code = held >> (bits - size) & ((1 << size) - 1)
            bits -= size
            if code == 256:
                table, size, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            piece = table[code] if code < len(table) else last + last[:1]
            out += piece
            if last:
                table.append(last + piece[:1])
            last = piece
            size = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs: a count below 128 takes that many bytes and one, above it repeats the next one."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


#: Fixed values of the format: packings by number.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def read(data, page: int, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A window of a page of a seekable file, black where it lies outside."""
    told = tiff.directories(data, pixels=True)[page]
    unpack = UNPACK.get(told.get("compression", (1,))[0])
    samples, bits = told.get("samples", (1,))[0], set(told.get("bits", (8,)))
    if unpack is None or bits != {8} or (told.get("planar", (1,))[0] != 1 and samples > 1):
        raise ValueError(f"packing {told.get('compression', (1,))[0]} with {sorted(bits)} bits isn't read")
    w, h = told["w"], told["h"]
    if told["tiled"]:
        across, down, at, sizes = told["tile_width"][0], told["tile_height"][0], told["tiles"], told["tile_sizes"]
    else:
        across, down, at, sizes = w, min(h, told.get("strip_rows", (h,))[0]), told["strips"], told["strip_sizes"]
    found, columns = np.zeros((height, width, 3), np.uint8), -(-w // across)
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + width, w), min(y + height, h)
    for row in range(y0 // down, -(-y1 // down) if x1 > x0 and y1 > y0 else 0):
        for column in range(x0 // across, -(-x1 // across)):
            k = row * columns + column
            data.seek(at[k])
            rows = down if told["tiled"] else min(down, h - row * down)
            block = np.frombuffer(unpack(data.read(sizes[k])), np.uint8)[: rows * across * samples].reshape(rows, across, samples)
            if told.get("predictor", (1,))[0] == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            block = np.repeat(block, 3, axis=2) if samples < 3 else block[:, :, :3]
            left, top = column * across, row * down
            a, b, c, d = max(x0, left), max(y0, top), min(x1, left + across), min(y1, top + rows)
            found[b - y : d - y, a - x : c - x] = block[b - top : d - top, a - left : c - left]
    return found


def regions(wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, page, x, y, width, height) with the window's bytes, or what went wrong."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, page, x, y, width, height in batch[["path", "page", "x", "y", "width", "height"]].itertuples(index=False):
                try:
                    with open(path, "rb") as data:
                        rows.append((path, page, x, y, width, height, read(data, page, x, y, width, height).tobytes(), None))
                except (OSError, ValueError, IndexError, KeyError, struct.error, zlib.error) as problem:
                    rows.append((path, page, x, y, width, height, None, str(problem)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    ship(wanted.sparkSession)
    return wanted.select("path", "page", "x", "y", "width", "height").mapInPandas(run, SCHEMA)

"""Slide metadata out of TIFF files, as a data source of one row per file.

Reads the tag directories only (classic and BigTIFF, either byte order): sizes, tiling, the
description. Tiled pages make the pyramid; the resolution comes from OME-XML in a
description, or from ``MPP = `` as some vendors write it.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Fixed values of the format: bytes per field type, and the tags that are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q", 11: "f", 12: "d"}
_WIDTH, _HEIGHT, _DESCRIPTION, _TILE_WIDTH = 256, 257, 270, 322
#: Fixed values of the format: tags of where pixels lie and how they are packed.
PIXELS = {259: "compression", 273: "strips", 277: "samples", 278: "strip_rows", 279: "strip_sizes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tiles", 325: "tile_sizes", 258: "bits"}
SCHEMA = "path string, kind string, width int, height int, main_ifd int, levels array<struct<w:int,h:int,dsx:double,dsy:double>>, mpp_x double, mpp_y double, objective double, error string"


def directories(data, pixels: bool = False) -> list[dict]:
    """Width, height, tiled and description of every page of a seekable file; ``pixels``: also where
    its pixels lie, by the names of ``PIXELS``, all values of each."""
    head = data.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        data.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), data.read(8 if big else 2))[0]
        entry, word = (20, 8) if big else (12, 4)
        block = data.read(n * entry + word)
        tags, found = {}, {}
        for k in range(n):
            raw = block[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(order + "HH", raw[:4])
            count = struct.unpack(order + ("Q" if big else "I"), raw[4 : 4 + word])[0]
            if tag not in (_WIDTH, _HEIGHT, _DESCRIPTION, _TILE_WIDTH) and not (pixels and tag in PIXELS):
                continue
            size, value = _SIZES.get(kind, 1) * count, raw[4 + word :]
            if size > word:
                data.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = data.read(size)
            if pixels and tag in PIXELS:
                found[PIXELS[tag]] = struct.unpack(f"{order}{count}{_CODES[kind]}", value[:size])
            tags[tag] = value[:size].rstrip(b"\0").decode("utf-8", "ignore") if kind == 2 else struct.unpack(order + _CODES[kind], value[: _SIZES[kind]])[0]
        pages.append({"w": tags.get(_WIDTH), "h": tags.get(_HEIGHT), "tiled": _TILE_WIDTH in tags, "description": tags.get(_DESCRIPTION, "")} | found)
        at = struct.unpack(order + ("Q" if big else "I"), block[n * entry : n * entry + word])[0]
    return pages


def main_page(pages: list[dict]) -> int | None:
    """The largest tiled page, or else the largest; the first of equals."""
    able = [(p["tiled"], (p["w"] or 0) * (p["h"] or 0), -k) for k, p in enumerate(pages) if p["w"] and p["h"]]
    return -max(able)[2] if able else None


_FACTORS = {"": 1.0, "µm": 1.0, "um": 1.0, "micrometer": 1.0, "micrometre": 1.0, "nm": 0.001, "mm": 1000.0}


def _number(text) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def ome(text: str | None, main_ifd: int | None) -> dict:
    """mpp_x, mpp_y, objective, width, height of the image that an OME-XML text describes.

    The image whose data names the main directory; or else the smallest physical size, of equals
    the one with most pixels; or else the one with most pixels. Control characters are taken
    out if the text doesn't parse; a text that still doesn't gives nothing."""
    nothing = {"mpp_x": None, "mpp_y": None, "objective": None, "width": None, "height": None}
    for attempt in (text or "", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text or "")):
        try:
            root = ET.fromstring(attempt)
            break
        except ET.ParseError:
            root = None
    if root is None:
        return nothing

    def local(node) -> str:
        return node.tag.rpartition("}")[2]

    images = []
    for image in (n for n in root.iter() if local(n) == "Image"):
        for pixels in (n for n in image if local(n) == "Pixels"):
            get = pixels.attrib.get
            x, y = (None if (v := _number(get(f"PhysicalSize{a}"))) is None else v * _FACTORS.get((get(f"PhysicalSize{a}Unit") or "").strip().lower(), 1.0) for a in "XY")
            ifds = {int(n.attrib.get("IFD", 0)) for n in pixels if local(n) == "TiffData" and (n.attrib.get("IFD", "0")).isdigit()}
            images.append({"mpp_x": x, "mpp_y": y, "width": int(_number(get("SizeX")) or 0), "height": int(_number(get("SizeY")) or 0), "ifds": ifds})
    if not images:
        return nothing
    size = lambda i: i["width"] * i["height"]
    named = [i for i in images if main_ifd is not None and main_ifd in i["ifds"]]
    scaled = [i for i in images if i["mpp_x"] is not None]
    chosen = named[0] if named else min(scaled, key=lambda i: (i["mpp_x"], -size(i))) if scaled else max(images, key=size)
    powers = [v for n in root.iter() if local(n) == "Objective" if (v := _number(n.attrib.get("NominalMagnification"))) is not None]
    return {k: chosen[k] for k in ("mpp_x", "mpp_y", "width", "height")} | {"objective": max(powers, default=None)}


def metadata(path: str) -> tuple:
    """One row of ``SCHEMA``; a file that can't be read says so in ``error``."""
    try:
        with open(path, "rb") as data:
            pages = directories(data)
    except (OSError, ValueError, struct.error, KeyError) as problem:
        return (path, None, None, None, None, None, None, None, None, str(problem))
    main = main_page(pages)
    if main is None:
        return (path, None, None, None, None, None, None, None, None, "no page with a size")
    w, h = pages[main]["w"], pages[main]["h"]
    tiled = [p for p in pages if p["tiled"] and p["w"] and p["h"]] or [pages[main]]
    levels = [(p["w"], p["h"], w / p["w"], h / p["h"]) for p in sorted(tiled, key=lambda p: -p["w"] * p["h"])]
    text = next((p["description"] for p in pages if "<OME" in p["description"]), None)
    if text:
        found = ome(text, main)
        x, y, power = found["mpp_x"], found["mpp_y"], found["objective"]
    else:
        described = " ".join(p["description"] for p in pages)
        x = y = _number(m[1]) if (m := re.search(r"MPP\s*=\s*([0-9.]+)", described)) else None
        power = _number(m[1]) if (m := re.search(r"AppMag\s*=\s*([0-9.]+)", described)) else None
    return (path, "pyramid" if len(levels) > 1 else "single", w, h, main, levels, x, y, power, None)


class SlideMetadata(DataSource):
    """``spark.read.format("slide_metadata").load(folder)``; register the class first."""

    @classmethod
    def name(cls) -> str:
        return "slide_metadata"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.top, self.size = options["path"], int(options.get("filesPerPartition", 64))

    def partitions(self) -> list[InputPartition]:
        found = sorted(f for f in glob.glob(os.path.join(self.top, "**"), recursive=True) if f.lower().endswith((".svs", ".btf", ".tif", ".tiff")))
        return [_Part(found[k : k + self.size]) for k in range(0, len(found), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            yield metadata(path)

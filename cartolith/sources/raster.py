"""Raster sources in long form (path, band, r, c, elev): ASCII grids and GeoTIFF in strips or tiles, plain or compressed
(deflate, LZW, PackBits), with predictors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, band int, r long, c long, elev double, x double, y double"


def ascii_grid(data: bytes) -> tuple[np.ndarray, dict]:
    head, rows = {}, []
    for line in data.decode().splitlines():
        parts = line.split()
        if parts and parts[0][0].isalpha():
            head[parts[0].lower()] = float(parts[1])
        elif parts:
            rows += map(float, parts)
    h, w = int(head["nrows"]), int(head["ncols"])
    size = head.get("cellsize", 1.0)
    meta = {"nodata": head.get("nodata_value"), "x0": head.get("xllcorner", 0.0), "y1": head.get("yllcorner", 0.0) + h * size, "dx": size, "dy": size}
    return np.array(rows).reshape(1, h, w), meta


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    out, table, width, bits, held, last = [], [], 9, 0, 0, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out.append(piece)
        last = piece
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += 2 + n
        else:
            out.append(data[i + 1 : i + 2] * (257 - n) if n > 128 else b"")
            i += 2 if n > 128 else 1
    return b"".join(out)


# fixed values: numbers of the compressions
UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits}


def _block(raw: bytes, predictor: int, e: str, kind: str, rows: int, width: int, samples: int) -> np.ndarray:
    """A strip's or tile's pixels [row, column, sample]."""
    size = int(kind[1:])
    if predictor == 3:  # bytes of a row in planes, highest first, each as the difference to the one before
        b = np.frombuffer(raw, np.uint8, rows * width * samples * size).reshape(rows, width * size, samples)
        b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(">" + kind).reshape(rows, width, samples)
    a = np.frombuffer(raw, e + kind, rows * width * samples).reshape(rows, width, samples)
    return np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("=")) if predictor == 2 else a


def _pixels(data: bytes, tags: dict, e: str, kind: str, w: int, h: int, bands: int) -> np.ndarray:
    """[band, row, column], from strips or tiles of all bands or of one each."""
    packing, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if packing not in UNPACK or predictor not in (1, 2, 3):
        raise ValueError(f"GeoTIFF compression {packing} with predictor {predictor} is not supported")
    tiled = 324 in tags
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    tw, th = (tags[322][0], tags[323][0]) if tiled else (w, min(h, tags.get(278, (h,))[0]))
    across, down = -(-w // tw), -(-h // th)
    planar = tags.get(284, (1,))[0] == 2
    out = np.zeros((bands, h, w))
    for i, (o, n) in enumerate(zip(offsets, counts, strict=True)):
        band, at = divmod(i, across * down) if planar else (slice(None), i)
        r, c = at // across * th, at % across * tw
        rows = th if tiled else min(th, h - r)  # the last strip is shorter, tiles are not
        part = _block(UNPACK[packing](data[o : o + n]), predictor, e, kind, rows, tw, 1 if planar else bands)
        part = part[: h - r, : w - c]
        out[band, r : r + part.shape[0], c : c + part.shape[1]] = part[:, :, 0] if planar else part.transpose(2, 0, 1)
    return out


def geotiff(data: bytes) -> tuple[np.ndarray, dict]:
    e = "<" if data[:2] == b"II" else ">"
    if struct.unpack(e + "H", data[2:4])[0] != 42:
        raise ValueError("BigTIFF is not supported")
    at = struct.unpack(e + "I", data[4:8])[0]
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
    tags = {}
    for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in kinds:
            continue
        form = f"{n}s" if kind == 2 else f"{n}{kinds[kind]}"
        size = struct.calcsize(e + form)
        where = at + 10 + 12 * i if size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        tags[tag] = struct.unpack(e + form, data[where : where + size])
    w, h, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(tags.get(258, (8,))[0] // 8)
    a = _pixels(data, tags, e, kind, w, h, bands)
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    nodata = float(tags[42113][0].split(b"\0")[0]) if 42113 in tags else None
    return a, {"nodata": nodata, "x0": tie[3] - tie[0] * scale[0], "y1": tie[4] + tie[1] * scale[1], "dx": scale[0], "dy": scale[1]}


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Cells with their centres; nodata is null."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                a, m = (geotiff if content[:2] in (b"II", b"MM") else ascii_grid)(content)
                for b in range(len(a)):
                    for r0 in range(0, a.shape[1], 256):
                        part = a[b, r0 : r0 + 256]
                        r, c = np.indices(part.shape)
                        v = part.ravel().copy()
                        if m["nodata"] is not None:
                            v[v == m["nodata"]] = np.nan
                        r, c = r.ravel() + r0, c.ravel()
                        yield pd.DataFrame({"path": name, "band": b + 1, "r": r, "c": c, "elev": v, "x": m["x0"] + (c + 0.5) * m["dx"], "y": m["y1"] - (r + 0.5) * m["dy"]}).assign(elev=lambda d: d.elev.astype(object).where(d.elev.notna(), None))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, SCHEMA)

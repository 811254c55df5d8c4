"""Image formats beside the plain ones: PNG, NIfTI-1, VTK points, gzip wrappers, animations, and folders of frames as volumes.

Parsers take a file's name and bytes and give rows, as those of `formats`, and run with its `scan`; writers return bytes.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import formats

# The signature of a PNG file, and how many samples a pixel of each colour type has.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_BANDS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: np.ndarray, rows: int, size: int, step: int) -> np.ndarray:
    """The bytes of PNG scanlines, of which each starts with the number of its filter."""
    raw = raw.reshape(rows, size + 1)
    out = np.zeros((rows + 1, size + step), np.int32)  # a row above and a pixel to the left, of zeros
    for y in range(rows):
        kind, line, up, now = int(raw[y, 0]), raw[y, 1:].astype(np.int32), out[y], out[y + 1]
        if kind == 0:
            now[step:] = line
        elif kind == 2:
            now[step:] = (line + up[step:]) & 255
        elif kind == 1:
            for c in range(step):
                now[step + c :: step] = np.cumsum(line[c::step]) & 255
        elif kind == 3:
            for x in range(size):
                now[x + step] = (line[x] + (now[x] + up[x + step]) // 2) & 255
        elif kind == 4:
            for x in range(size):
                a, b, c = int(now[x]), int(up[x + step]), int(up[x])
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                now[x + step] = (line[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        else:
            raise ValueError(f"filter {kind}")
    return out[1:, step:].astype(np.uint8)


def decode_png(raw: bytes) -> np.ndarray:
    """(y, x, band) of a PNG that is not interlaced; palettes become R, G, B."""
    if raw[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, palette, head = 8, [], None, None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG image")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None:
        raise ValueError("PNG image without a header")
    nx, ny, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG images are not read")
    bands = PNG_BANDS[colour]
    size, step = -(-nx * bands * depth // 8), max(1, bands * depth // 8)
    lines = _unfiltered(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8), ny, size, step)
    if depth == 16:
        out = lines.view(">u2").astype(np.int64)
    elif depth == 8:
        out = lines.astype(np.int64)
    else:
        bits = np.unpackbits(lines, axis=1)[:, : nx * bands * depth].reshape(ny, -1, depth)
        out = (bits << np.arange(depth - 1, -1, -1)).sum(2).astype(np.int64)
    out = out.reshape(ny, nx, bands)
    return palette[out[:, :, 0]].astype(np.int64) if colour == 3 and palette is not None else out


def write_png(data: np.ndarray) -> bytes:
    """PNG of (y, x) or (y, x, band) with 1 to 4 bands; 16 bits if a value is above 255."""
    data = data[:, :, None] if data.ndim == 2 else data
    ny, nx, bands = data.shape
    depth = 16 if data.size and data.max() > 255 else 8
    lines = np.ascontiguousarray(data.astype(">u2" if depth == 16 else "u1")).view(np.uint8).reshape(ny, -1)
    raw = np.concatenate((np.zeros((ny, 1), np.uint8), lines), 1).tobytes()
    colour = {n: kind for kind, n in PNG_BANDS.items() if kind != 3}[bands]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", nx, ny, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def parse_png(name: str, raw: bytes) -> Iterator[tuple]:
    """One row per pixel with its bands; schema `formats.PNM`."""
    data = decode_png(raw)
    nx = data.shape[1]
    for p, feat in enumerate(data.reshape(-1, data.shape[2]).tolist()):
        yield name, p, p % nx, p // nx, feat


# --- volumes

VOLUME = "image_id string, p long, x int, y int, z int, val double"
# Numeric types of NIfTI-1 by their codes.
NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def decode_nifti(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """(z, y, x) values and the sizes of a voxel of a NIfTI-1 file in one piece; scaling is applied."""
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348 or raw[344:347] != b"n+1":
        raise ValueError("not a NIfTI-1 image in one file")
    dim, kind = struct.unpack(order + "8h", raw[40:56]), struct.unpack(order + "h", raw[70:72])[0]
    size, (offset, slope, inter) = struct.unpack(order + "8f", raw[76:108]), struct.unpack(order + "3f", raw[108:120])
    nx, ny, nz = (max(1, d) if k < dim[0] else 1 for k, d in enumerate(dim[1:4]))
    data = np.frombuffer(raw, order + NIFTI[kind], nx * ny * nz, int(offset)).astype(float).reshape(nz, ny, nx)
    return (data * slope + inter if slope else data), tuple(float(s) for s in size[1:4])


def write_nifti(data: np.ndarray, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    """NIfTI-1 of (z, y, x): whole numbers as 32-bit integers, others as 32-bit floats."""
    whole = np.issubdtype(data.dtype, np.integer)
    nz, ny, nx = data.shape
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, nx, ny, nz, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 8 if whole else 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *voxel, 0.0, 0.0, 0.0, 0.0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + data.astype("<i4" if whole else "<f4").tobytes()


def _voxels(name: str, data: np.ndarray) -> Iterator[tuple]:
    nz, ny, nx = data.shape
    for p, v in enumerate(data.ravel().tolist()):
        yield name, p, p % nx, p // nx % ny, p // (nx * ny), float(v)


def parse_nifti(name: str, raw: bytes) -> Iterator[tuple]:
    """One row per voxel; a gzipped file is unpacked."""
    yield from _voxels(name, decode_nifti(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)[0])


def write_vtk(data: np.ndarray, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    """Structured points of (z, y, x) as text."""
    nz, ny, nx = data.shape
    head = f"# vtk DataFile Version 3.0\nvolume\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} {nz}\nORIGIN 0 0 0\nSPACING {voxel[0]:g} {voxel[1]:g} {voxel[2]:g}\nPOINT_DATA {data.size}\nSCALARS volume int 1\nLOOKUP_TABLE default\n"
    return (head + " ".join(map(str, data.ravel().tolist())) + "\n").encode()


def parse_vtk(name: str, raw: bytes) -> Iterator[tuple]:
    head, _, body = raw.partition(b"LOOKUP_TABLE")
    shape = re.search(rb"DIMENSIONS\s+(\d+)\s+(\d+)\s+(\d+)", head)
    if not shape or b"STRUCTURED_POINTS" not in head or b"ASCII" not in head:
        raise ValueError(f"{name}: not structured points as text")
    nx, ny, nz = map(int, shape.groups())
    yield from _voxels(name, np.array(body.split()[1:], float).reshape(nz, ny, nx))


def zipped(raw: bytes) -> bytes:
    """Any file's bytes as a gzip file, the same each time."""
    return gzip.compress(raw, mtime=0)


def parse_zipped(parse):
    """A parser of gzipped files from one of plain files."""
    return lambda name, raw: parse(name, gzip.decompress(raw))


PARSERS = {"png": (parse_png, formats.PNM), "pgm": (formats.parse_pnm, formats.PNM), "ppm": (formats.parse_pnm, formats.PNM), "mimg": (formats.parse_mimg, formats.MIMG), "nii": (parse_nifti, VOLUME), "vtk": (parse_vtk, VOLUME)}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels or voxels of the files of `path`, by the extension of its name, also with `.gz` behind it."""
    parts = path.lower().rsplit("/", 1)[-1].split(".")
    packed = parts[-1] == "gz"
    kind = parts[-2] if packed and len(parts) > 1 else parts[-1]
    if kind not in PARSERS:
        raise ValueError(f"no reader for {kind}")
    parse, schema = PARSERS[kind]
    return formats.scan(spark, path, parse_zipped(parse) if packed and kind != "nii" else parse, schema)


def frames_as_volume(frames: DataFrame) -> DataFrame:
    """(x, y, z, val) of grey frames (image_id, x, y, feat): z is the number of the frame in the order of names."""
    names = frames.select("image_id").distinct().withColumn("z", (F.row_number().over(W.orderBy("image_id")) - 1).cast("int"))
    return frames.join(F.broadcast(names), "image_id").select("x", "y", "z", F.col("feat")[0].alias("val"))


def sequence(volumes: DataFrame, at: int, volume: DataFrame) -> DataFrame:
    """Volumes (t, x, y, z, val) with the one at time `at` replaced by, or extended with, another (x, y, z, val)."""
    return volumes.where(F.col("t") != at).unionByName(volume.select(F.lit(at).cast(dict(volumes.dtypes)["t"]).alias("t"), "x", "y", "z", "val"))


def moment_slice(volumes: DataFrame, t: int, z: int) -> DataFrame:
    """(x, y, val) of one slice at one time."""
    return volumes.where((F.col("t") == t) & (F.col("z") == z)).select("x", "y", "val")


# --- animations


def write_gif(frames: np.ndarray, delay: int = 10) -> bytes:
    """An animation of grey frames (t, y, x) of values 0 to 127, each a hundredth of a second times `delay`.

    Pixels are written as codes of eight bits with a clear code before the table would grow, so that no table is needed.
    """
    t, ny, nx = frames.shape
    table = b"".join(bytes((2 * k, 2 * k, 2 * k)) for k in range(128))
    out = [b"GIF89a", struct.pack("<HHBBB", nx, ny, 0xF6, 0, 0), table, b"!\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for frame in frames.astype(np.uint8):
        flat, codes = (frame & 127).ravel().tolist(), bytearray()
        for at in range(0, len(flat), 126):
            codes.append(128)
            codes += bytes(flat[at : at + 126])
        codes.append(129)
        blocks = b"".join(bytes((len(b),)) + bytes(b) for b in (codes[k : k + 255] for k in range(0, len(codes), 255)))
        out += [b"!\xf9\x04\x00", struct.pack("<H", delay), b"\x00\x00", b",", struct.pack("<HHHHB", 0, 0, nx, ny, 0), b"\x07", blocks, b"\x00"]
    return b"".join([*out, b";"])


def gif_frames(raw: bytes) -> list[list[int]]:
    """The pixel values of each frame that `write_gif` has written."""
    found = []
    at = 13 + 3 * 128
    while raw[at : at + 1] != b";":
        if raw[at : at + 1] == b"!":
            at += 2
        else:
            at += 11
            codes = b""
        body = b""
        while raw[at]:
            body += raw[at + 1 : at + 1 + raw[at]]
            at += 1 + raw[at]
        at += 1
        if body and body[0] == 128:
            codes = body
            found.append([c for c in codes if c < 128])
    return found

"""Media columns (operator 5): Netpbm and BMP images in binary columns.

Images are decoded to numpy arrays without an image library, resized by area with integral images (summed-area
tables), written as NPY tiles, and described by a difference hash.
"""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import column, mapped, whole_text

WIDTH, BLOCK, TILE = 24, 576, 24
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\S+)")


def encode_pgm(a: np.ndarray) -> bytes:
    """Binary Netpbm: P5 for a grey image (rows, columns), P6 for (rows, columns, 3)."""
    return b"P%d\n%d %d\n255\n" % (6 if a.ndim == 3 else 5, a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """An uncompressed BMP: 8 bits with a grey palette for (rows, columns), 24 bits for (rows, columns, 3)."""
    bits = 24 if a.ndim == 3 else 8
    rows = (a[::-1, :, ::-1] if bits == 24 else a[::-1]).reshape(a.shape[0], -1)
    data = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).astype(np.uint8).tobytes()
    palette = b"" if bits == 24 else np.repeat(np.arange(256, dtype="<u4") * 0x010101, 1).tobytes()
    at = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", at + len(data), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, a.shape[1], a.shape[0], 1, bits, 0, len(data), 2835, 2835, len(palette) // 4, 0) + palette + data


def _netpbm(blob: bytes) -> np.ndarray:
    kind, at, fields = int(blob[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _FIELD.match(blob, at)
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = (*fields, 1)[:3]
    if not 0 < most < 1 << 16:
        raise ValueError("no such greatest sample")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    if kind == 1:
        return ((1 - np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", blob[at:])[:n], np.uint8).reshape(shape).astype(int) + 48) * 255).astype(np.uint8)
    if kind in (2, 3):
        a = np.array(re.sub(rb"#[^\n]*", b"", blob[at:]).split()[:n], dtype=np.int64)
    else:
        a = np.frombuffer(blob, ">u2" if most > 255 else np.uint8, n, at + 1)
    return (a if most == 255 else (a.astype(np.int64) * 255 + most // 2) // most).astype(np.uint8).reshape(shape)


def _bmp(blob: bytes) -> np.ndarray:
    at, head, width, height, _, bits, packed = struct.unpack_from("<I", blob, 10) + struct.unpack_from("<IiiHHI", blob, 14)
    if packed:
        raise ValueError("compressed BMP")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    a = np.frombuffer(blob, np.uint8, stride * rows, at).reshape(rows, stride)
    a = a if height < 0 else a[::-1]
    if bits in (24, 32):
        return a[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1].copy()
    if bits < 8:
        a = np.unpackbits(a, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
    used = (at - 14 - head) // 4
    palette = np.frombuffer(blob, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
    a = palette[a[:, :width]]
    return a[:, :, 0].copy() if (palette == palette[:, :1]).all() else a


def decode(blob: bytes | None) -> np.ndarray | None:
    """8-bit samples (rows, columns[, 3]) of a Netpbm (P1 to P6) or BMP image; None for null, another format or a damaged file."""
    try:
        if blob and blob[:1] == b"P" and blob[1:2] in b"123456":
            return _netpbm(blob)
        return _bmp(blob) if blob and blob[:2] == b"BM" else None
    except (ValueError, IndexError, TypeError, struct.error):
        return None


def area_resize(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over each target cell's area, cut pixels in proportion; from an integral image, so the cost doesn't depend on the cell's size."""
    grey = a.astype(np.float64) if a.ndim == 2 else a.astype(np.float64) @ (0.299, 0.587, 0.114)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def along(t: np.ndarray, n: int) -> np.ndarray:
        x = np.linspace(0, t.shape[0] - 1, n + 1)
        low = np.minimum(x.astype(int), t.shape[0] - 2)
        part = (x - low)[:, None]
        return t[low] * (1 - part) + t[low + 1] * part

    corner = along(along(total, rows).T, cols).T
    return np.diff(np.diff(corner, axis=0), axis=1) / (grey.shape[0] / rows * (grey.shape[1] / cols))


def difference_hash(a: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = np.round(area_resize(a, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    """The array as a .npy file."""
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def media_columns(images: DataFrame, keep: list[str], media_col: str = "media", tile: int = TILE) -> DataFrame:
    """The columns `keep`, then rows, cols, channels, samples (the decoded bytes), tile (a .npy of tile x tile 8-bit samples), dhash.

    Null, damaged and foreign media give nulls; a row comes out for each row that goes in, repeated ones too. Columns
    that aren't in `keep` are ignored, so names may clash.
    """
    kinds = {k: images.schema[k].dataType.simpleString() for k in keep}
    made = ("rows", "cols", "channels", "samples", "tile", "dhash")

    def make(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in made}
        for blob in column(batch, media_col).to_pylist():
            a = decode(blob)
            whole = a is not None and a.size > 0
            for n, v in zip(made, (a.shape[0], a.shape[1], 3 if a.ndim == 3 else 1, a.tobytes(), npy(np.round(area_resize(a, tile, tile)).astype(np.uint8)), difference_hash(a)) if whole else (None,) * 6, strict=True):
                out[n].append(v)
        return out | {k: column(batch, k) for k in keep}

    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", rows int, cols int, channels int, samples binary, tile binary, dhash string"
    return mapped(images.select(*dict.fromkeys([*keep, media_col])), make, schema, media_col)


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm") -> DataFrame:
    """Each text as an image of 24 columns: doc_id, n_bytes, media (its bytes, padded by 255 to a positive multiple of 576).

    `form` is pgm (P5) or bmp. Null texts are empty and give one block of padding. Equal texts give equal images.
    """
    write = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def make(batch: pa.RecordBatch) -> dict:
        raw = [t.encode() for t in column(batch, "text").to_pylist()]
        media = [write(np.frombuffer(b.ljust(max(1, -(-len(b) // BLOCK)) * BLOCK, b"\xff"), np.uint8).reshape(-1, WIDTH)) for b in raw]
        return {"doc_id": column(batch, "doc_id"), "n_bytes": [len(b) for b in raw], "media": media}

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), make, "doc_id long, n_bytes long, media binary")

"""Media columns: Netpbm and BMP blobs decoded to numpy arrays, area-resized by
integral images, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import plain_text

#: Bytes in a row of the stored picture: 64 pixels of three samples.
ROW_BYTES, ROW_PIXELS = 192, 64
#: Edge of a tile.
TILE = 16
#: Columns and rows of the grid whose neighbours a difference hash compares.
HASH_COLUMNS, HASH_ROWS = 8, 8

#: Netpbm kinds: samples of a pixel, and whether the samples are written as text.
NETPBM = {b"P1": (1, True), b"P2": (1, True), b"P3": (3, True), b"P4": (1, False), b"P5": (1, False), b"P6": (3, False)}
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """``height x width x samples`` (uint8, or uint16 where the largest value is over 255)."""
    samples, as_text = NETPBM[data[:2]]
    bitmap, at, fields = data[:2] in (b"P1", b"P4"), 2, []
    for _ in range(2 if bitmap else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = [*fields, 1][:3]
    n = width * height * samples
    if not 0 < most < 1 << 16:
        raise ValueError("the largest value must have 16 bits")
    if height * -(-width // 8) > len(data) - at or not (bitmap and not as_text) and n > len(data) - at:
        raise ValueError("Netpbm data end early")
    if as_text:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        found = re.findall(rb"[01]" if bitmap else rb"\d+", body)[:n]
        values = list(map(int, found))
        if max(values, default=0) > most:
            raise ValueError("a sample is over the largest value")
        flat = np.array(values, "u2")
    elif bitmap:
        per_row = -(-width // 8)
        rows = np.frombuffer(data, "u1", per_row * height, at + 1).reshape(height, per_row)
        flat = np.unpackbits(rows, axis=1)[:, :width].ravel().astype("u2")
    else:
        flat = np.frombuffer(data, "u1" if most < 256 else ">u2", n, at + 1)
    if len(flat) != n:
        raise ValueError("Netpbm data end early")
    if bitmap:
        flat, most = (1 - flat) * 255, 255
    return flat.astype("u1" if most < 256 else "u2").reshape(height, width, samples)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as ``height x width x 3`` in red, green, blue."""
    at, head = (int.from_bytes(data[k : k + 4], "little") for k in (10, 14))
    width, height = (int.from_bytes(data[k : k + 4], "little", signed=True) for k in (18, 22))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if bits not in (8, 24, 32) or packing:
        raise ValueError("only plain BMP of 8, 24 or 32 bits")
    per_row, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
    if width <= 0 or at < 14 + head or per_row * rows > len(data) - at:
        raise ValueError("BMP data end early")
    body = np.frombuffer(data, "u1", per_row * rows, at).reshape(rows, per_row)[:, : width * bits // 8]
    if bits == 8:
        palette = np.frombuffer(data, "u1", (at - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        out = palette[body][..., 2::-1]
    else:
        out = body.reshape(rows, width, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:2] in NETPBM:
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


#: What decoding a broken picture may raise.
BROKEN = (ValueError, KeyError, IndexError, OverflowError)


def decoded(data: bytes) -> np.ndarray:
    """The picture, which has pixels."""
    image = decode(data)
    if not image.size:
        raise ValueError("no pixels")
    return image


def encode_ppm(samples: bytes, width: int) -> bytes:
    """A binary Netpbm colour picture of these 8-bit samples."""
    return b"P6\n%d %d\n255\n" % (width, len(samples) // (3 * width)) + samples


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over each target cell's area. The integral image is read between its
    grid points by linear interpolation, which is exact for areas."""
    integral = np.zeros((image.shape[0] + 1, image.shape[1] + 1, image.shape[2]))
    np.cumsum(image, 0, float, integral[1:, 1:])
    np.cumsum(integral[1:, 1:], 1, float, integral[1:, 1:])
    for axis, n in ((0, rows), (1, columns)):
        size = image.shape[axis]
        edge = np.arange(n + 1) * (size / n)
        low = np.minimum(edge.astype(int), size - 1)
        part = (edge - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        integral = integral.take(low, axis) * (1 - part) + integral.take(low + 1, axis) * part
    cells = np.diff(np.diff(integral, axis=0), axis=1)
    return cells / (image.shape[0] / rows * image.shape[1] / columns)


def grey(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.299, 0.587, 0.114]) if image.shape[2] == 3 else image[..., 0]


def difference_hash(image: np.ndarray) -> str:
    """A bit for each pair of neighbours in a row of the small grid, as hex."""
    small = np.round(grey(area_resize(image, HASH_ROWS, HASH_COLUMNS + 1)), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, edge: int = TILE) -> bytes:
    """The picture in an ``edge x edge`` tile of 8-bit samples, in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, edge, edge)), 0, 255).astype("u1"))
    return out.getvalue()


def media_columns(df: DataFrame, id_col: str, blob_col: str, edge: int = TILE) -> DataFrame:
    """``id_col, width, height, samples, tile, dhash, error`` of every blob.

    A null, broken or unknown blob, or one without pixels, has null columns and the
    reason in ``error``. Repeated rows stay repeated; other columns are not read.
    """

    @F.pandas_udf("width int, height int, samples int, tile binary, dhash string, error string")
    def columns(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for data in blobs:
            try:
                image = decoded(bytes(data or b""))
                rows.append((*image.shape[1::-1], image.shape[2], npy_tile(image, edge), difference_hash(image), None))
            except BROKEN as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "samples", "tile", "dhash", "error"]).astype(
            {"width": "Int32", "height": "Int32", "samples": "Int32"}
        )

    return df.select(F.col(id_col), columns(F.col(blob_col)).alias("_m")).select(id_col, "_m.*")


def text_payload(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and these filled with spaces to a positive multiple of a row."""
    raw = text.encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES - len(raw))


def stored_pictures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, picture``: every whole text as a lossless Netpbm colour picture
    (null as the empty text, which is one row of spaces)."""

    @F.pandas_udf("n_bytes long, picture binary")
    def pictures(texts: pd.Series) -> pd.DataFrame:
        rows = [(n, encode_ppm(p, ROW_PIXELS)) for n, p in map(text_payload, texts)]
        return pd.DataFrame(rows, columns=["n_bytes", "picture"])

    return docs.select(F.col(id_col), pictures(plain_text(text_col)).alias("_p")).select(id_col, "_p.*")


def picture_digests(pictures: DataFrame, id_col: str, n_col: str, blob_col: str) -> DataFrame:
    """What the stored bytes give when read back: payload digests, the stored form's
    digest, and the difference hash as ``feature``, with the tile's digest. A null picture
    has null columns; one that can't be decoded, or has no pixels, has those of the stored
    form alone."""

    @F.pandas_udf(
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    )
    def digests(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for data in blobs:
            if data is None:
                rows.append((None,) * 7)
                continue
            data = bytes(data)
            form = (len(data), hashlib.sha256(data).hexdigest())
            try:
                image = decoded(data)
            except BROKEN:
                rows.append((None, None, None, *form, None, None))
                continue
            payload = image.tobytes()
            rows.append(
                (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *form)
                + (difference_hash(image), hashlib.sha256(npy_tile(image)).hexdigest())
            )
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
        return pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})

    return pictures.select(F.col(id_col), F.col(n_col), digests(F.col(blob_col)).alias("_d")).select(
        id_col, n_col, "_d.*"
    )

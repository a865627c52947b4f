"""Media columns: Netpbm and BMP bytes, NPY tiles, area resizing and difference hashes.

Pictures are decoded to numpy arrays.  A resize gives each target pixel the exact mean
of the source area it covers, read from an integral image.  Tiles are stored in the NPY
format, one array per row, in a Parquet table that Spark commits.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces, scratch_path

#: Rows and columns of a tile of the stored form.
SIDE = 24


def encode_pnm(image: np.ndarray) -> bytes:
    """Grey (h, w) as P5 or colour (h, w, 3) as P6, 8 bits a sample."""
    h, w = image.shape[:2]
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_pnm(data: bytes) -> np.ndarray:
    """P1 to P6 with comments; samples of more than 8 bits are big-endian 16-bit."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm picture")
    pattern, at, fields = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)"), 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = pattern.match(data, at)
        if not m:
            raise ValueError("the header of the picture ends early")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    if not w or not h:
        raise ValueError("the picture has no rows or no columns")
    depth = 3 if kind in (b"P3", b"P6") else 1
    most = fields[2] if len(fields) > 2 else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        found = re.findall(rb"[01]" if kind == b"P1" else rb"\d+", body)
        out = np.array(found[: w * h * depth], dtype=np.int64)
        if kind == b"P1":
            out = 1 - out
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        out = 1 - np.unpackbits(rows, axis=1)[:, :w].astype(np.int64)
    else:
        out = np.frombuffer(data, np.uint8 if most < 256 else ">u2", w * h * depth, at + 1)
    if out.size != w * h * depth:
        raise ValueError("the picture has too few samples")
    if kind in (b"P1", b"P4"):
        out = out * 255
    out = out.astype(np.uint8 if most < 256 else np.uint16)
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits, rows up or down; bit fields only in the usual order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    start, header, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    usual = packed == 3 and bits == 32 and struct.unpack_from("<III", data, 54) == (0xFF0000, 0xFF00, 0xFF)
    if not (packed == 0 or usual) or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("this kind of BMP is not supported")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits >= 24:
        out = raw[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    else:
        n = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(n, 4)[:, 2::-1]
        index = raw if bits == 8 else np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], -1).reshape(rows, -1)
        out = palette[index[:, :w]]
    return np.ascontiguousarray(out if h < 0 else out[::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """Colour (h, w, 3) as 24-bit BMP."""
    h, w, _ = image.shape
    stride = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_pnm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of colour pictures in integer arithmetic, in samples of the same size; grey ones as they are."""
    if image.ndim == 2:
        return image
    r, g, b = (image[:, :, k].astype(np.int64) for k in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(image.dtype)


def resize_area(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of the area under each target pixel, exact, as float64.

    The integral image is read at fractional edges by linear interpolation, which is
    exact because the integral of a pixel is linear inside the pixel.
    """
    h, w = image.shape
    total = np.zeros((h + 1, w + 1), np.float64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def cut(table: np.ndarray, n: int, axis: int) -> np.ndarray:
        size = table.shape[axis] - 1
        edge = np.arange(n + 1) * size / n
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = edge - low
        shape = [-1, 1] if axis == 0 else [1, -1]
        part = part.reshape(shape)
        return table.take(low, axis) * (1 - part) + table.take(low + 1, axis) * part

    box = np.diff(np.diff(cut(cut(total, rows, 0), cols, 1), axis=0), axis=1)
    return box / (h / rows * w / cols)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits: whether a pixel of the 8 x 9 picture is brighter than its right neighbour."""
    small = resize_area(grey(image), 8, 9)
    bits = (small[:, :-1] > small[:, 1:] + 1e-9).reshape(-1)
    return np.packbits(bits).tobytes().hex()


def to_npy(tiles: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tiles, allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tiles_of(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A grey picture whose sides are multiples of ``side`` as (n, side, side), row by row."""
    h, w = image.shape
    return image.reshape(h // side, side, w // side, side).swapaxes(1, 2).reshape(-1, side, side)


def image_of(tiles: np.ndarray, across: int = 1) -> np.ndarray:
    n, side, _ = tiles.shape
    return tiles.reshape(n // across, across, side, side).swapaxes(1, 2).reshape(n // across * side, across * side)


def payload_of(text: str | None, side: int = SIDE) -> bytes:
    """UTF-8 bytes, then bytes 255 up to a positive multiple of a tile."""
    data = (text or "").encode()
    block = side * side
    size = max(block, -(-len(data) // block) * block)
    return data + b"\xff" * (size - len(data))


def picture_of(payload: bytes, side: int = SIDE) -> bytes:
    """The payload as the samples of a P5 picture one tile wide."""
    return encode_pnm(np.frombuffer(payload, np.uint8).reshape(-1, side))


def write_tiles(media: DataFrame, path: str, *, id_col: str, media_col: str, extra: tuple[str, ...] = (), side: int = SIDE) -> None:
    """Decodes each picture and writes its tiles as one NPY array a row, with the columns ``extra``.

    A null picture is written as a null array.  One that can't be decoded is too, with the
    reason in ``error``, and stops nothing else.  Pictures of any size are padded with white to
    whole tiles; ``rows`` and ``cols`` keep the size before that.  Samples of 16 bits stay so.
    """
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in (id_col, *extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 200):
            out: list[tuple] = []
            for data in batch.column(len(extra) + 1):
                try:
                    out.append((*tiled(grey(decode(data.as_py())), side), None) if data.is_valid else (None, None, None, None))
                except (ValueError, IndexError, struct.error) as e:
                    out.append((None, None, None, str(e)))
            rows, cols, stored, errors = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(extra) + 1)), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(stored, pa.binary()), pa.array(errors, pa.string())], [id_col, *extra, "rows", "cols", "npy", "error"])

    media.select(id_col, *extra, media_col).mapInArrow(run, f"{kinds}, rows int, cols int, npy binary, error string").write.option("compression", "zstd").parquet(path)


def tiled(image: np.ndarray, side: int = SIDE) -> tuple[int, int, bytes]:
    """Rows and columns of a grey picture, and its tiles as an NPY array."""
    h, w = (-(-x // side) * side for x in image.shape)
    whole = np.full((h, w), np.iinfo(image.dtype).max, image.dtype)
    whole[: image.shape[0], : image.shape[1]] = image
    return *image.shape, to_npy(tiles_of(whole, side))


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Texts as pictures: stored as NPY tiles, read back, and described from what was read.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (the difference hash).  A null or empty text is a tile of 255s.
    Null and repeated ids are kept, an empty table gives an empty result, and other columns
    of ``docs`` are ignored.  Equal texts give equal values.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or scratch_path(spark, "tiles")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 200):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([picture_of(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    write_tiles(source.mapInArrow(draw, f"doc_id {kind}, n_bytes bigint, media binary"), path, id_col="doc_id", media_col="media", extra=("n_bytes",))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 200):
            out: list[list] = [[] for _ in range(6)]
            for cell in batch.column(2):
                data = cell.as_py()
                tiles = from_npy(data)
                payload = tiles.tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image_of(tiles)))
                for k, v in enumerate(row):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    back = spark.read.parquet(path).select("doc_id", "n_bytes", "npy")
    return back.mapInArrow(describe, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")

"""Media columns: Netpbm and BMP images to numpy arrays, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, slices

WIDTH, TILE = 64, 1024


class MediaError(ValueError):
    """Bytes that are not an image of a known form."""


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    values, at = [], 2
    while len(values) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                at = (data.find(b"\n", at) + 1) or len(data)
            else:
                at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise MediaError("broken Netpbm header")
        values.append(int(data[at:end]))
        at = end
    return values, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3) of uint8, or of uint16 for maxima over 255.

    Bitmaps become 0 (black) and 255. Raises MediaError for anything cut short.
    """
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not Netpbm")
    bitmap, deep = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    head, at = _netpbm_header(data, 2 if bitmap else 3)
    (w, h), top = head[:2], 1 if bitmap else head[2]
    if not (w > 0 and h > 0 and 0 < top < 65536):
        raise MediaError("impossible size or maximum")
    n = w * h * deep
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, offset=at)
        if len(rows) < h * ((w + 7) // 8):
            raise MediaError("cut short")
        bits = np.unpackbits(rows[: h * ((w + 7) // 8)].reshape(h, -1), axis=1)[:, :w]
        return np.where(bits, 0, 255).astype(np.uint8)
    if kind in (b"P5", b"P6"):
        form = np.dtype("u1" if top < 256 else ">u2")
        if len(data) - at < n * form.itemsize:
            raise MediaError("cut short")
        flat = np.frombuffer(data, form, n, at).astype(form.newbyteorder("="))
    else:
        text = data[at - 1 :]
        items = [bytes([c]) for c in text if c in b"01"] if kind == b"P1" else text.split()
        if len(items) < n:
            raise MediaError("cut short")
        flat = np.array([int(x) for x in items[:n]], np.uint8 if top < 256 else np.uint16)
        if bitmap:
            flat = np.where(flat, 0, 255).astype(np.uint8)
    if not bitmap and flat.max() > top:
        raise MediaError("a sample over the maximum")
    return flat.reshape((h, w, 3) if deep == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits a pixel as (height, width, 3) of uint8."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not BMP")
    start, head, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or depth not in (8, 24, 32) or w <= 0 or h == 0:
        raise MediaError("a BMP form that is not supported")
    line = (w * depth // 8 + 3) // 4 * 4
    if len(data) < start + line * abs(h):
        raise MediaError("cut short")
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if depth == 8:
        table = np.frombuffer(data, np.uint8, min(256, (start - 14 - head) // 4) * 4, 14 + head).reshape(-1, 4)
        return table[np.minimum(rows[:, :w], len(table) - 1)][:, :, 2::-1].copy()
    return rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    """The array of a Netpbm or BMP file. Raises MediaError, and nothing else, for any bytes that are neither."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except MediaError:
        raise
    except (ValueError, OverflowError, IndexError, struct.error) as e:
        raise MediaError(f"broken file: {e}") from e


def encode_pgm(samples: np.ndarray) -> bytes:
    """A P5 file of a uint8 array (height, width)."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit BMP of a uint8 array (height, width, 3)."""
    h, w, _ = pixels.shape
    line = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + h * line, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * line, 2835, 2835, 0, 0) + rows.tobytes()


def _edges(integral: np.ndarray, n: int) -> np.ndarray:
    """Differences, along the first axis, of an integral (with its leading zero) at n equal, possibly fractional, steps."""
    at = np.linspace(0, len(integral) - 1, n + 1)
    low = np.minimum(at.astype(np.int64), len(integral) - 2)
    part = (at - low).reshape(-1, *[1] * (integral.ndim - 1))
    return np.diff(integral[low] * (1 - part) + integral[low + 1] * part, axis=0)


def area_resize(image: np.ndarray, height: int, width: int, strip: int = 4096) -> np.ndarray:
    """Mean of the covered area for each target pixel, from integrals along both axes (float64).

    The rows are integrated in strips, so that memory beyond the image is that of a strip and of height x width columns.
    """
    h, w = image.shape[:2]
    tail = image.shape[2:]
    narrow = np.empty((h, width, *tail))
    for at in range(0, h, strip):
        sums = np.zeros((w + 1, len(image[at : at + strip]), *tail))
        np.cumsum(np.swapaxes(image[at : at + strip], 0, 1), axis=0, dtype=np.float64, out=sums[1:])
        narrow[at : at + strip] = np.swapaxes(_edges(sums, width), 0, 1)
    sums = np.zeros((h + 1, width, *tail))
    np.cumsum(narrow, axis=0, out=sums[1:])
    return _edges(sums, height) / (h * w / (height * width))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each pixel of the 9 x 8 area-resized grey image is darker than its right neighbour."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tiles(image: np.ndarray, height: int = 256, width: int = 256) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY file) of each tile; those at the right and lower edge are smaller."""
    for y in range(0, image.shape[0], height):
        for x in range(0, image.shape[1], width):
            np.save(out := io.BytesIO(), np.ascontiguousarray(image[y : y + height, x : x + width]), allow_pickle=False)
            yield y // height, x // width, out.getvalue()


def read_npy_tiles(tiles: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The image again."""
    rows: dict[int, list] = {}
    for y, x, data in sorted(tiles, key=lambda t: t[:2]):
        rows.setdefault(y, []).append(np.load(io.BytesIO(data), allow_pickle=False))
    return np.concatenate([np.concatenate(r, axis=1) for _, r in sorted(rows.items())], axis=0)


def read_npy_files(data: bytes) -> list[np.ndarray]:
    """The arrays of NPY files that stand one after another."""
    whole, out = io.BytesIO(data), []
    while whole.tell() < len(data):
        out.append(np.load(whole, allow_pickle=False))
    return out


def media_tiles(df: DataFrame, key: str, column: str, height: int = 0, width: int = 0, tile: int = 256) -> DataFrame:
    """(key, error, n_tile rows) of a binary column of Netpbm or BMP files.

    One row per tile: key, tile_row, tile_col, tile (an NPY file), dhash (of the whole image), error. With height and
    width the image is area-resized first (rounded, uint8). Null, empty and broken files give one row with error set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("key", batch.schema.field("key").type), ("tile_row", pa.int32()), ("tile_col", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])
            for k, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
                try:
                    image = decode(data or b"")
                    mark = difference_hash(image)
                    if height and width:
                        image = np.round(area_resize(image, height, width)).astype(np.uint8)
                    rows = [(k, y, x, t, mark, None) for y, x, t in npy_tiles(image, tile, tile)]
                except MediaError as e:
                    rows = [(k, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    few = df.select(F.col(key).alias("key"), F.col(column).cast("binary").alias("data"))
    kind = few.schema["key"].dataType.simpleString()
    return few.mapInArrow(run, f"key {kind}, tile_row int, tile_col int, tile binary, dhash string, error string")


def text_as_image(text: bytes) -> bytes:
    """The text and zeros up to a positive multiple of 64 bytes as an image 64 wide: a BMP in colour, three bytes a
    pixel, if they fill its lines, else a P5 file in grey."""
    payload = np.frombuffer(text + bytes(-len(text) % WIDTH or (0 if text else WIDTH)), np.uint8)
    if len(payload) % (3 * WIDTH) == 0:
        return encode_bmp(payload.reshape(-1, WIDTH, 3))
    return encode_pgm(payload.reshape(-1, WIDTH))


def text_media(docs: DataFrame) -> DataFrame:
    """Makes an image of each text (null: empty), decodes it, stores it as NPY tiles, reads these back and describes them.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (difference hash).
    Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in binary_texts(batch):
                    stored = b"".join(tile for _, _, tile in npy_tiles(decode(text_as_image(text)), TILE, WIDTH))
                    tiles = read_npy_files(stored)
                    image = tiles[0] if len(tiles) == 1 else np.concatenate(tiles)
                    back = image.tobytes()
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark, sf_dir):
    from .common import documents

    return text_media(documents(spark, sf_dir))

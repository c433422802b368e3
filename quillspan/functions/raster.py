"""Images as arrays of rows: flips, resizing, thresholds, lead grids, column envelopes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.signal import SAMPLES

LEADS = (("I", "AVR", "V1", "V4"), ("II", "AVL", "V2", "V5"), ("III", "AVF", "V3", "V6"))
MARGIN = 0.05
LEAST_COLUMNS = 10


def rows_of(flat: str | Column, width: int) -> Column:
    """A flat array to an array of rows."""
    a = F.col(flat) if isinstance(flat, str) else flat
    return F.transform(F.sequence(F.lit(0), (F.size(a) / width).cast("int") - 1), lambda r: F.slice(a, r * width + 1, F.lit(width)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def flip(image: Column) -> Column:
    return F.transform(image, F.reverse)


def flip_average(image: Column, flipped: Column) -> Column:
    """Mean of the predictions of an image and of its mirror image, the latter mirrored back."""
    return F.zip_with(image, flip(flipped), lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2))


def threshold_mask(image: Column, t: float) -> Column:
    return F.transform(image, lambda r: F.transform(r, lambda x: F.when(x > t, 255).otherwise(0)))


def unit_scale(image: Column) -> Column:
    return F.transform(image, lambda r: F.transform(r, lambda x: x / F.lit(255.0)))


def resize_nearest(image: Column, height: int, width: int) -> Column:
    """Source index floor(i * old / new)."""
    h, w = F.size(image), F.size(F.get(image, F.lit(0)))
    row = lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.get(r, F.floor(x * w / F.lit(width)).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: row(F.get(image, F.floor(y * h / F.lit(height)).cast("int"))))


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the covered source area."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.arange(new + 1) * old / new
        cells = np.arange(old)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * new / old

    return weights(image.shape[0], height) @ image.astype(float) @ weights(image.shape[1], width).T


def lead_patches(df: DataFrame, key: str, image: str) -> DataFrame:
    """(key, lead, patch): the three upper rows of a 4 x 4 grid, less an inner margin; a margin of 0 gives an empty patch."""
    img = F.col(image)
    sized = df.select(key, img.alias("__i"), (F.size(img) / 4).cast("int").alias("__h"), (F.size(F.get(img, F.lit(0))) / 4).cast("int").alias("__w"))
    sized = sized.withColumns({"__my": (F.col("__h") * MARGIN).cast("int"), "__mx": (F.col("__w") * MARGIN).cast("int")})
    parts = []
    for r, names in enumerate(LEADS):
        for c, name in enumerate(names):
            inner = F.slice("__i", F.lit(r) * F.col("__h") + F.col("__my") + 1, F.greatest(F.col("__h") - 2 * F.col("__my"), F.lit(0)))
            left = F.lit(c) * F.col("__w") + F.col("__mx") + 1
            cut = F.transform(inner, _columns(left, F.greatest(F.col("__w") - 2 * F.col("__mx"), F.lit(0))))
            empty = (F.col("__my") == 0) | (F.col("__mx") == 0)
            parts.append(F.struct(F.lit(name).alias("lead"), F.when(empty, F.slice(cut, 1, 0)).otherwise(cut).alias("patch")))
    return sized.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.lead", "p.patch")


def _columns(first: Column, n: Column):
    return lambda row: F.slice(row, first, n)


def column_envelope(df: DataFrame, keys: list[str], image: str, lit_over: float = 0.0) -> DataFrame:
    """(keys, x, height, y_min, y_max, mid) of the columns that have a lit pixel; mid = height - (y_min + y_max) / 2.

    Lit rows of a column are found within the image's row; only columns are grouped, so images of equal keys are one.
    """
    img = F.col(image)
    rows, wide = F.sequence(F.lit(0), F.size(img) - 1), F.array_max(F.transform(img, F.size))
    lit = F.transform(F.sequence(F.lit(0), wide - 1), lambda x: F.filter(rows, lambda y: F.get(F.get(img, y), x) > lit_over))
    columns = df.where(F.size(img) > 0).select(*keys, F.size(img).alias("height"), F.posexplode(lit).alias("x", "__ys")).where(F.size("__ys") > 0)
    ends = columns.select(*keys, "x", "height", F.element_at("__ys", 1).alias("y_min"), F.element_at("__ys", -1).alias("y_max"))
    return ends.groupBy(*keys, "x", "height").agg(F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max")).withColumn("mid", F.col("height") - (F.col("y_min") + F.col("y_max")) / 2)


def trace(envelope: DataFrame, keys: list[str], least: int = LEAST_COLUMNS) -> DataFrame:
    """(keys, n_valid, first_x, last_x, signal): the mid line from the first valid column to the last, null in gaps.

    Fewer than `least` valid columns give a signal of SAMPLES zeros.
    """
    pairs = F.map_from_entries(F.collect_list(F.struct("x", "mid")))
    out = envelope.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"), F.min("x").alias("first_x"), F.max("x").alias("last_x"), pairs.alias("__m"))
    line = F.transform(F.sequence("first_x", "last_x"), lambda x: F.try_element_at("__m", x))
    return out.withColumn("signal", F.when(F.col("n_valid") >= least, line).otherwise(F.array_repeat(F.lit(0.0), SAMPLES))).drop("__m")


def deskew_angle(image: np.ndarray, limit: float = 15.0, step: float = 0.25) -> float:
    """The angle in degrees (within the limit) whose row profile varies most; 0 if below half a degree.

    A deterministic stand-in for a randomised line search.
    """
    ys, xs = np.nonzero(image)
    if not len(ys):
        return 0.0
    best = (-1.0, 0.0, 0.0)
    for a in np.arange(-limit + step, limit, step):
        rows = np.round(ys - xs * np.tan(np.radians(a))).astype(int)
        spread = float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())
        best = max(best, (spread, -abs(float(a)), float(a)))
    return best[2] if abs(best[2]) >= 0.5 else 0.0


def rotate_nearest(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle, background 0."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w]
    a = np.radians(degrees)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.round(cy + (y - cy) * np.cos(a) + (x - cx) * np.sin(a)).astype(int)
    sx = np.round(cx - (y - cy) * np.sin(a) + (x - cx) * np.cos(a)).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside, image[sy.clip(0, h - 1), sx.clip(0, w - 1)], 0)


def write_png(image: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = image.shape
    raw = b"".join(b"\0" + image[y].astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """The bytes of a PNG's rows without their filters; step: the distance of a byte to its left neighbour's."""
    h, width = raw.shape[0], raw.shape[1] - 1
    out, above = np.zeros((h, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:]
        if kind == 1:
            whole = np.zeros(-(-width // step) * step, np.uint8)
            whole[:width] = line
            line = np.cumsum(whole.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)[:width]
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):  # each byte needs the one before: plain integers
            done, up = bytearray(step) + bytearray(line.tobytes()), bytes(step) + above.tobytes()
            for x in range(step, step + width):
                a, b, c = done[x - step], up[x], up[x - step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[x] = (done[x] + guess) & 255
            line = np.frombuffer(bytes(done[step:]), np.uint8)
        elif kind:
            raise ValueError(f"unknown PNG filter {kind}")
        out[y], above = line, line
    return out


def read_png(data: bytes) -> np.ndarray:
    """A grey image of 8 bits from a PNG file without interlace: colours and palettes by luma, 16 bits by their upper 8, fewer bits spread to 0..255; alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head, palette = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlace or depth not in (1, 2, 4, 8, 16) or (colour == 3 and palette is None):
        raise ValueError("only PNG files without interlace are read")
    rows = _unfiltered(np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + -(-w * channels * depth // 8)), max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    image = rows[:, : w * channels].reshape(h, w, channels)
    if colour == 3:
        image = palette[image[:, :, 0]]
    elif channels < 3:
        return image[:, :, 0]
    return np.round(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)

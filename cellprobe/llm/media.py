"""Cropped and edited copies of images, by local descriptors.

Corners are the strict local maxima of a corner measure on several scales, so a crop keeps those inside it.
Each has an orientation (its patch's intensity centroid) and 64 binary tests at places that turn with it.
Images with the same pixels are one entry. Descriptors are indexed by either half of their bits; equal halves
make candidates, and the Hamming distance verifies them. Matches of two images vote for the similarity
transform that they imply; enough distinct corners for one transform link the images, and connected images
form a class.

A run of one index key of up to ``all_pairs`` corners is compared pair by pair. In a longer one, such as the
corners of a logo on very many images, each corner is first compared with the run's first ones and its next ones.
Then all pairs of the longer runs whose images the links so far do not connect are compared as well, and vote together
with what their images share in other runs. So classes are those of all links; of the links, only enough are made.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellprobe.llm.components import components
from cellprobe.llm.io import cut, drop, integral, written

PATCH, NMS, TURNS, LEVELS = 7, 7, 32, 3
_FEATURE = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "u1"), ("turn", "u1"), ("d", "<u8")])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a binary PGM or PPM, or of an 8-bit PNG without interlace; None for anything else."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            m = re.match(rb"P[56]\s+(\d+)\s+(\d+)\s+255\s", data)
            w, h, n = int(m[1]), int(m[2]), 1 if data[1:2] == b"5" else 3
            return _grey(np.frombuffer(data, np.uint8, w * h * n, m.end()).reshape(h, w, n))
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, TypeError, struct.error, zlib.error, KeyError):
        pass
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].copy()
    return (pixels[:, :, :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)).astype(np.uint8)


def _png(data: bytes) -> np.ndarray:
    at, parts, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace:
        raise ValueError("unsupported PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.int64)
    for y in range(h):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        if kind == 2:
            line = line + above
        elif kind:
            for x in range(len(line)):
                a, c = (line[x - channels], above[x - channels]) if x >= channels else (0, 0)
                b = above[x]
                nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else nearest)) & 255
        above = line & 255
        out[y] = above
    return _grey(out.reshape(h, w, channels))


def encode(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r + 1, cut at the border."""
    s = np.zeros((x.shape[0] + 2 * r + 1, x.shape[1] + 2 * r + 1), np.float64)
    s[r + 1 : r + 1 + x.shape[0], r + 1 : r + 1 + x.shape[1]] = x
    s = s.cumsum(0).cumsum(1)
    n = 2 * r + 1
    return s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]


def _largest(x: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of side 2r + 1."""
    for axis in (0, 1):
        x = np.moveaxis(x, axis, 0)
        p = np.concatenate([np.full((r, *x.shape[1:]), -np.inf), x, np.full((r, *x.shape[1:]), -np.inf)])
        n, width = 2 * r + 1, 1
        while 2 * width <= n:
            p = np.maximum(p[:-width], p[width:])
            width *= 2
        if n > width:
            p = np.maximum(p[: len(p) - (n - width)], p[n - width :])
        x = np.moveaxis(p, 0, axis)
    return x


def _pattern() -> np.ndarray:
    """Places of the 64 pairs, for each of the turns: (turn, pair, end, xy)."""
    rng = np.random.default_rng(20)
    pairs = np.clip(rng.normal(0, PATCH / 2.2, (64, 2, 2)), -PATCH + 1.5, PATCH - 1.5)
    angles = 2 * np.pi * np.arange(TURNS) / TURNS
    rotate = np.stack([np.stack([np.cos(angles), -np.sin(angles)], 1), np.stack([np.sin(angles), np.cos(angles)], 1)], 1)
    return np.clip(np.rint(np.einsum("tij,pej->tpei", rotate, pairs)), -PATCH, PATCH).astype(np.int64)


_PATTERN = _pattern()
_YY, _XX = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]


def features(grey: np.ndarray) -> np.ndarray:
    """Corners of all scales with their descriptors."""
    out, level = [np.zeros(0, _FEATURE)], grey.astype(np.float64)
    for scale in range(LEVELS):
        if min(level.shape) < 2 * PATCH + 4:
            break
        gy, gx = np.zeros_like(level), np.zeros_like(level)
        gy[1:-1], gx[:, 1:-1] = level[2:] - level[:-2], level[:, 2:] - level[:, :-2]
        a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
        corner = np.rint(a * c - b * b - 0.05 * (a + c) ** 2)
        edge = PATCH + 1
        inner = corner[edge:-edge, edge:-edge]
        ys, xs = np.nonzero((inner == _largest(corner, NMS)[edge:-edge, edge:-edge]) & (inner > 1e4))
        ys, xs = ys + edge, xs + edge
        if len(ys):
            smooth = _box(level, 1)
            patches = level[ys[:, None, None] + _YY, xs[:, None, None] + _XX]
            turn = np.rint(np.arctan2((patches * _YY).sum((1, 2)), (patches * _XX).sum((1, 2))) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
            places = _PATTERN[turn]
            first = smooth[ys[:, None] + places[:, :, 0, 1], xs[:, None] + places[:, :, 0, 0]]
            second = smooth[ys[:, None] + places[:, :, 1, 1], xs[:, None] + places[:, :, 1, 0]]
            rows = np.zeros(len(ys), _FEATURE)
            rows["x"], rows["y"], rows["scale"], rows["turn"] = xs * 2**scale, ys * 2**scale, scale, turn
            rows["d"] = np.packbits(first < second, axis=1).view(">u8")[:, 0]
            out.append(rows)
        h, w = level.shape[0] // 2 * 2, level.shape[1] // 2 * 2
        level = (level[:h:2, :w:2] + level[1:h:2, :w:2] + level[:h:2, 1:w:2] + level[1:h:2, 1:w:2]) / 4
    return np.concatenate(out)


def described(images: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """(id, pixels, corners): a digest of the grey pixels (null if there are none) and the packed features; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, packed = [], []
            for data in batch.column(1):
                grey = decode(data.as_py())
                digests.append(None if grey is None else hashlib.sha256(b"%d " % grey.shape[1] + grey.tobytes()).digest()[:16])
                packed.append(None if grey is None else features(grey).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["id", "pixels", "corners"])

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, image_col).mapInArrow(run, f"id {kind}, pixels binary, corners binary")


_ROW = np.dtype([("key", "<i8"), ("image", "<i8"), ("x", "<f4"), ("y", "<f4"), ("scale", "<i4"), ("turn", "<i4"), ("d", "<i8")])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each corner and half of its descriptor."""
    for batch in batches:
        for image, data in zip(batch.column(0), batch.column(1), strict=True):
            f = np.frombuffer(data.as_py(), _FEATURE)
            if len(f):
                halves = [(f["d"] & np.uint64(0xFFFFFFFF)).astype(np.int64), (f["d"] >> np.uint64(32)).astype(np.int64) | 1 << 32]
                columns = {"key": np.concatenate(halves), "image": np.full(2 * len(f), image.as_py()), **{c: np.tile(f[c], 2) for c in ("x", "y")}, **{c: np.tile(f[c], 2).astype(np.int32) for c in ("scale", "turn")}, "d": np.tile(f["d"].view(np.int64), 2)}
                yield pa.RecordBatch.from_pydict(columns)


#: Corners that share a key, each with its image; each task compares so many of a long run with all of it.
_CORNER, PART = ("image", "x", "y", "scale", "turn"), 2000
_VOTE = "a bigint, b bigint, scale int, turn int, offset int, dx int, dy int, spot bigint"


def _transforms(a: dict[str, np.ndarray], b: dict[str, np.ndarray], bin_size: float) -> pa.RecordBatch:
    """Votes of matching corners a and b, a of the lesser image: the transforms that take a to b."""
    scale = b["scale"] - a["scale"]
    turn = (b["turn"] - a["turn"]) % TURNS
    angle, zoom = 2 * np.pi * turn / TURNS, np.exp2(scale)
    dx = b["x"] - zoom * (np.cos(angle) * a["x"] - np.sin(angle) * a["y"])
    dy = b["y"] - zoom * (np.sin(angle) * a["x"] + np.cos(angle) * a["y"])
    half = np.repeat([0.0, 0.5], len(scale))  # bins at two offsets, so that no border parts near votes
    cell = lambda v: np.floor(np.tile(v, 2) / bin_size + half).astype(np.int32)
    spot = (a["x"].astype(np.int64) << 32) | (a["y"].astype(np.int64) << 4) | a["scale"]
    twice = lambda v: np.tile(v, 2)
    return pa.RecordBatch.from_pydict({"a": twice(a["image"]), "b": twice(b["image"]), "scale": twice(scale).astype(np.int32), "turn": twice(turn).astype(np.int32), "offset": (2 * half).astype(np.int32), "dx": cell(dx), "dy": cell(dy), "spot": twice(spot)})


def _voted(bin_size: float):
    """Pairs of corners, the columns of each with its side's name before them, to votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ({c: batch.column(f"{side}_{c}").to_numpy(zero_copy_only=False) for c in _CORNER} for side in "ab")
            yield _transforms(a, b, bin_size)

    return run


def _votes(distance: int, all_pairs: int, bin_size: float):
    """Candidate matches in runs of equal keys, as votes for a transform; of long runs neighbours only."""

    def pairs(row: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = row["key"]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        for lag in range(1, min(int(sizes.max()), all_pairs)):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & ((size[lag:] <= all_pairs) | (lag <= 4)))
            if not len(i):
                break
            yield i, i + lag
        long = np.flatnonzero(size > all_pairs)
        for k in range(4):  # with the run's first ones
            j = long[long > first[long] + k + 4]
            yield first[j] + k, j

    def matched(row: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        found = []
        for i, j in pairs(row):
            near = (row["image"][i] != row["image"][j]) & (np.bitwise_count((row["d"][i] ^ row["d"][j]).view(np.uint64)) <= distance)
            found.append((i[near], j[near]))
        i, j = (np.concatenate([f[side] for f in found]) for side in (0, 1)) if found else (np.zeros(0, np.int64),) * 2
        if not len(i):
            return None
        swap = row["image"][i] > row["image"][j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        a, b = ({c: row[c][k] for c in _CORNER} for k in (i, j))
        return _transforms(a, b, bin_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            row = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in _ROW.names}
            if held is not None:
                row = {n: np.concatenate([held[n], row[n]]) for n in _ROW.names}
            if not len(row["key"]):
                continue
            end = int(np.searchsorted(row["key"], row["key"][-1], "left"))
            if end == 0 and len(row["key"]) > 64 * all_pairs:  # a very long run goes piece by piece, its first ones stay
                if out := matched(row):
                    yield out
                held = {n: np.concatenate([v[:4], v[-4:]]) for n, v in row.items()}
                continue
            if end and (out := matched({n: v[:end] for n, v in row.items()})):
                yield out
            held = {n: v[end:] for n, v in row.items()}
        if held is not None and len(held["key"]) and (out := matched(held)):
            yield out

    return run


def _linked(votes: DataFrame, least: int) -> DataFrame:
    counted = votes.groupBy("a", "b", "scale", "turn", "offset", "dx", "dy").agg(F.count_distinct("spot").alias("n")).where(F.col("n") >= least)
    return counted.select("a", "b").distinct()


def image_links(entries: DataFrame, distance: int = 6, least: int = 6, all_pairs: int = 64, bin_size: float = 6.0) -> DataFrame:
    """(a, b): links that connect all images (id bigint, corners binary) with ``least`` distinct corners in one transform."""
    spark = entries.sparkSession
    index = entries.select("id", "corners").mapInArrow(_index, "key bigint, image bigint, x float, y float, scale int, turn int, d bigint")
    votes, path = written(index.repartition("key").sortWithinPartitions("key", "image").mapInArrow(_votes(distance, all_pairs, bin_size), _VOTE), hashes=True)
    links = cut(_linked(votes, least))
    runs = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > all_pairs))
    if not runs.isEmpty():
        parts = components(links).select(F.col("node").alias("image"), F.col("component").alias("part"))
        known = cut(index.join(runs, "key").join(parts, "image", "left").withColumn("part", F.coalesce("part", "image")))
        mixed = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
        rows = cut(known.join(mixed, "key", "left_semi"))
        a = rows.withColumn("share", F.explode(F.expr(f"sequence(0L, n div {PART})"))).alias("a")
        b = rows.withColumn("share", F.pmod(F.xxhash64("image", "x", "y"), F.expr(f"1 + n div {PART}"))).alias("b")
        same = (F.col("a.key") == F.col("b.key")) & (F.col("a.share") == F.col("b.share")) & (F.col("a.image") < F.col("b.image")) & (F.col("a.part") != F.col("b.part"))
        near = F.bit_count(F.col("a.d").bitwiseXOR(F.col("b.d"))) <= distance
        met = a.join(b, same & near).select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in _CORNER])
        more, more_path = written(met.mapInArrow(_voted(bin_size), _VOTE), hashes=True)
        # A pair's corners may meet in long runs and in others: all its votes count, each spot once.
        before = votes.join(more.select("a", "b").distinct(), ["a", "b"], "left_semi")
        links = cut(links.unionAll(_linked(before.unionAll(more.select(before.columns)), least)))
        drop(spark, more_path)
    drop(spark, path)
    return links


def copy_classes(images: DataFrame, id_col: str = "id", image_col: str = "image", **options) -> DataFrame:
    """(id, n_corners, class_id) of every row: the least id of the class.

    Null or undecodable images are classes of their own, with n_corners null. Rows with a null id get the class of
    the images that theirs equals, or null. Repeated rows and equal images share a class. Images too small for a
    corner are only ever linked to equal ones; large ones are read whole, by one task each. An empty table gives no
    rows; other columns are not read. Ids that are not integers raise TypeError.
    """
    integral(images, id_col)
    rows = cut(described(images, id_col, image_col).withColumn("id", F.col("id").cast("long")))
    entries = cut(rows.where("pixels is not null and id is not null").groupBy("pixels").agg(F.min("id").alias("id"), F.first("corners").alias("corners")))
    # Rows that share an id but not their pixels would be one node: the entry's own number keeps them apart.
    entries = entries.withColumn("node", F.xxhash64("pixels"))
    parts = components(image_links(entries.select(F.col("node").alias("id"), "corners"), **options))
    classed = entries.select("pixels", "id", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classed.groupBy("component").agg(F.min("id").alias("class_id"))
    by_pixels = cut(classed.join(least, "component").select("pixels", "class_id"))
    out = rows.join(by_pixels, "pixels", "left")
    n = (F.octet_length("corners") / _FEATURE.itemsize).cast("int")
    return out.select(F.col("id").alias(id_col), n.alias("n_corners"), F.coalesce("class_id", "id").alias("class_id"))


_BLOCK_TAG = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|</?(?:p|h\d|li|div|br|article|nav|title|body|ul)\b[^>]*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def page_raster(html: str | None, width: int = 64) -> bytes | None:
    """A page as a grey image: a line for each ``width`` characters of a block's text, a pixel for a character."""
    if html is None:
        return None
    lines = []
    for block in _BLOCK_TAG.split(html):
        text = " ".join(_TAG.sub("", block).split())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(codes), width):
            line = np.zeros(width, np.uint8)
            part = codes[at : at + width]
            line[: len(part)] = (part * 37 + part // 256) % 256
            lines.append(line)
    return encode(np.array(lines, np.uint8).reshape(-1, width)) if lines else encode(np.zeros((1, width), np.uint8))


def page_images(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, image) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page_raster(h.as_py()) for h in part.column(1)], pa.binary())], names=[id_col, "image"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, image binary")

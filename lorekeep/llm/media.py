"""Copies among images by local descriptors.

Grey images (width, height, one byte for each pixel) get corners on every level of a pyramid whose levels
are ``RATIO`` apart, as many as there are: their number grows with the area.  A corner is placed between pixels, its orientation is
that of its patch's intensity centroid; binary tests on the detail around it (differences of two
local means), turned by the orientation, are tried, and the 63 best make a descriptor.  The tests are chosen among random ones, by a fixed rule, to be even and little
correlated on textured noise.  The keys of the Hamming tables are made of two neighbouring corners of a level: equal pieces of both descriptors, how the second one lies to
the first one's orientation, and their distance in steps.  One corner alone (that of a plain rectangle, say) looks alike in many pictures; two that also lie alike hardly do, so what
shares a key by chance is little.  Keys don't tell levels apart, so corners meet their counterparts in a resized copy.

Images that share a key are nominated, and each nominated pair is verified once, by all corners of both: every corner meets the other image's nearest
one, whose mark (63 bits of the descriptor) is at most ``BITS`` bits away, and votes for a rotation, a scale and a shift; at least
``VOTES`` corners at different places must agree, and at least ``VOTING`` of the corners of the image that has fewer.  Cropped, resized, brightened, partly covered or turned copies keep enough of them.

Images with equal pixels are one class at once and go on as one.  Buckets are counted by partial aggregates: one of two images is a pair.  In a larger one
all images meet the largest, then those outside the bucket's main class meet the
rest that is in another class, a bounded number each round; no bucket is capped.  Large buckets are salted, so that one may hold any share of the images.

Defined results: the class is named by its smallest image_id.  An image whose data
are null or don't fit its width and height has no corners and a class of its own, as has one that is
too small or flat.  A key that an image repeats counts once.  Rows with one image_id count as one image with all their corners.
A row with a null image_id gets a null class.  An empty table gives no rows.  An image is described whole, in about 100 bytes a pixel.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.buckets import first_rows, salted, to_bucket
from lorekeep.llm.common import saved, small, table
from lorekeep.llm.near_dup import components

#: Sizes of neighbouring levels, reach of a patch and width of an image's unused border in pixels, distance of neighbouring corners.
RATIO, REACH, BORDER, APART = 1.15, 6, 8, 3
#: Reach of the wider mean that detail is told from.
AROUND = 5
#: Tests that are chosen; the first ones, which are the most even, are a corner's mark.
TESTS, MARK = 168, 63
#: Tables, and tests of each corner that make up a table's key.
TABLES, PIECE = 3, 18
#: Neighbours that a corner is paired with, looked for in cells of so many pixels and those around them.
NEIGHBOURS, CELL = 4, 16
#: Steps of the angles between two corners, and of their distance.
BEARINGS, LENGTHS = 12, 1.4
#: Bits in which two marks of one corner may differ.
BITS = 9
#: Directions that orientations are rounded to for the vote.
TURNS = 32
#: Corners that must agree on a transformation, also as a part of the corners of the image with fewer; the cell of a shift in pixels, or as a part of the image's side.
VOTES, VOTING, SHIFT, PART = 4, 0.01, 8.0, 0.2
#: Images of a bucket that meet the rest of it in one round.
ROUND = 16
SIZE = 80
#: Steps of the orientation that a spot holds.
FINE = 256
CORNERS = "marks array<bigint>, spots array<bigint>"


def windows(a: np.ndarray, n: int, axis: int, join: np.ufunc) -> np.ndarray:
    """``join`` (a sum, a maximum) of every ``n`` neighbours along one of the last two axes, from windows of doubled widths."""

    def part(of: np.ndarray, begin: int, length: int) -> np.ndarray:
        return of[..., begin : begin + length, :] if axis == -2 else of[..., begin : begin + length]

    length, joined, done, width, total = a.shape[axis] - n + 1, a, 0, 1, None
    while True:
        if n & width:
            piece = part(joined, done, length)
            total = piece if total is None else join(total, piece)
            done += width
        if 2 * width > n:
            return total
        left = joined.shape[axis] - width
        joined, width = join(part(joined, 0, left), part(joined, width, left)), 2 * width


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1)-squares of the last two axes, edges repeated."""
    h, w = a.shape[-2:]
    wide = np.empty((*a.shape[:-2], h + 2 * r, w + 2 * r))
    wide[..., r : r + h, r : r + w] = a
    wide[..., :r, r : r + w], wide[..., r + h :, r : r + w] = a[..., :1, :], a[..., -1:, :]
    wide[..., :r], wide[..., r + w :] = wide[..., r : r + 1], wide[..., r + w - 1 : r + w]
    return windows(windows(wide, 2 * r + 1, -2, np.add), 2 * r + 1, -1, np.add)


def summed(image: np.ndarray) -> np.ndarray:
    """Sums of the pixels above and left of every place between pixels."""
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    image.astype(float).cumsum(axis=0).cumsum(axis=1, out=sums[1:, 1:])
    return sums


def resized(sums: np.ndarray, factor: float) -> np.ndarray:
    """The image with these ``summed`` pixels, smaller by ``factor``: each new pixel is the mean of the area it covers."""

    def rows(a: np.ndarray) -> np.ndarray:
        edges = np.arange(int((len(a) - 1) / factor) + 1) * factor
        at = np.minimum(edges.astype(int), len(a) - 2)
        part = ((edges - at) / factor)[:, None]
        reached = a[at] * (1 / factor - part) + a[at + 1] * part
        return reached[1:] - reached[:-1]

    return rows(rows(sums).T).T


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels."""
    row, col = y.astype(int), x.astype(int)
    fy, fx = y - row, x - col
    flat, width = image.ravel(), image.shape[1]
    at = row * width + col
    above, below = flat.take(at), flat.take(at + width)
    above += (flat.take(at + 1) - above) * fx
    below += (flat.take(at + width + 1) - below) * fx
    return above + (below - above) * fy


def corner_points(image: np.ndarray) -> np.ndarray:
    """(row, column), between pixels, of the local maxima of the structure tensor's smaller eigenvalue."""
    h, w = image.shape
    gy, gx = np.zeros((h, w)), np.zeros((h, w))
    gy[1:-1], gx[:, 1:-1] = image[2:] - image[:-2], image[:, 2:] - image[:, :-2]
    a, b, c = box(box(np.stack([gx * gx, gy * gy, gx * gy]), 2), 1)
    strength = (a + b) / 2 - np.sqrt(np.square((a - b) / 2) + c * c)
    inner = strength[BORDER - APART : h - BORDER + APART, BORDER - APART : w - BORDER + APART]
    peak = windows(windows(inner, 2 * APART + 1, -2, np.maximum), 2 * APART + 1, -1, np.maximum)
    own = inner[APART:-APART, APART:-APART]
    y, x = np.nonzero((own == peak) & (own > max(1.0, 0.01 * own.max())))
    y, x = y + BORDER, x + BORDER

    def between(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
        bend = before - 2 * here + after
        return np.where(bend < 0, np.clip((before - after) / 2 / np.where(bend < 0, bend, -1.0), -0.5, 0.5), 0.0)

    here = strength[y, x]
    return np.stack([y + between(strength[y - 1, x], here, strength[y + 1, x]), x + between(strength[y, x - 1], here, strength[y, x + 1])], axis=1)


def disc() -> np.ndarray:
    """Offsets (row, column) of the round patch."""
    span = np.arange(-REACH, REACH + 1)
    dy, dx = np.meshgrid(span, span, indexing="ij")
    return np.stack([dy, dx], axis=-1)[dy * dy + dx * dx <= REACH * REACH]


def contrasts(image: np.ndarray, tests: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """(size of the level's pixels, corners, orientations, differences of the tests' ends) for every level."""
    patch, sums, level, number = disc(), summed(image), image, 0
    down, right = tests[..., 0].ravel(), tests[..., 1].ravel()
    while min(level.shape) > 2 * BORDER + 2:
        local = box(level, 1)
        points = corner_points(local)
        if len(points):
            y, x = points[:, 0], points[:, 1]
            around = sampled(local, y[:, None] + patch[None, :, 0], x[:, None] + patch[None, :, 1])
            angle = np.arctan2(around @ patch[:, 0], around @ patch[:, 1])
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
            detail = local / 9 - box(level, AROUND) / (2 * AROUND + 1) ** 2
            ends = sampled(detail, y[:, None] + right * sin + down * cos, x[:, None] + right * cos - down * sin).reshape(-1, *tests.shape[:2])
            yield RATIO**number, points, angle, ends[..., 0] - ends[..., 1]
        number += 1
        if min(image.shape) / RATIO**number <= 2 * BORDER + 2:
            return
        level = resized(sums, RATIO**number)


@cache
def chosen_tests(tried: int = 1200, seed: int = 3) -> np.ndarray:
    """``TESTS`` pairs of (row, column) offsets, the most even and least correlated of random ones on textured noise."""
    rng = np.random.default_rng(seed)
    radius, bearing = REACH * np.sqrt(rng.uniform(0, 1, (tried, 2))), rng.uniform(0, 2 * np.pi, (tried, 2))
    tests = np.stack([radius * np.sin(bearing), radius * np.cos(bearing)], axis=-1)
    tests = tests[np.hypot(*(tests[:, 0] - tests[:, 1]).T) >= 0.3 * REACH]
    seen = []
    for _ in range(16):
        noise = sum((z := box(box(rng.normal(size=(96, 96)), k), k)) / z.std() * k**0.7 for k in (1, 2, 4, 8))
        for y, x, h, w in rng.integers(0, 96, (10, 4)):
            noise[y : y + h // 3 + 6, x : x + w // 3 + 6] += 3 * rng.normal()
        seen += [d for *_, d in contrasts(np.clip(128 + 25 * noise, 0, 255), tests)]
    bits = (np.concatenate(seen) < 0).astype(float)
    apart = bits - bits.mean(axis=0)
    unit = apart / (np.sqrt(np.square(apart).sum(axis=0)) + 1e-9)
    alike, order = np.abs(unit.T @ unit), np.argsort(np.abs(bits.mean(axis=0) - 0.5), kind="stable")
    taken, most, free = [], 0.25, np.ones(len(order), bool)
    worst = np.zeros(len(order))
    while len(taken) < TESTS:
        for i in order:
            if free[i] and worst[i] < most and len(taken) < TESTS:
                taken.append(i)
                free[i] = False
                worst = np.maximum(worst, alike[i])
        most += 0.05
    return tests[taken]


def neighbours(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): distinct pairs, i < j, of a corner and one of its ``NEIGHBOURS`` nearest in the cells around it."""
    row, col = (points // CELL).astype(np.int64).T
    stride = int(col.max()) + 3
    cell = row * stride + col + 1
    order, found = np.argsort(cell, kind="stable"), []
    held = cell[order]
    for begin in range(0, len(points), 1024):
        own = np.arange(begin, min(begin + 1024, len(points)))
        middle = cell[own, None] + np.array([-stride, 0, stride])  # three cells of a row are one run
        first, last = np.searchsorted(held, middle - 1), np.searchsorted(held, middle + 1, side="right")
        place = first[..., None] + np.arange((last - first).max())
        other = order[np.minimum(place, len(points) - 1)]
        apart = np.square(points[other] - points[own, None, None]).sum(axis=-1)
        apart[(place >= last[..., None]) | (other == own[:, None, None])] = np.inf
        apart, other = apart.reshape(len(own), -1), other.reshape(len(own), -1)
        nearest = np.argsort(apart, axis=1, kind="stable")[:, :NEIGHBOURS]
        near = np.isfinite(np.take_along_axis(apart, nearest, axis=1))
        one, other = np.broadcast_to(own[:, None], near.shape)[near], np.take_along_axis(other, nearest, axis=1)[near]
        found.append(np.minimum(one, other) * len(points) + np.maximum(one, other))
    return np.divmod(np.unique(np.concatenate(found)), len(points))


def pair_keys(points: np.ndarray, angle: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The table keys of a level's neighbouring corners; of a pair, the corner with the smaller piece comes first."""
    i, j = neighbours(points)
    pieces = marks[:, None] >> PIECE * np.arange(TABLES) & (1 << PIECE) - 1
    p, q = pieces[i], pieces[j]
    one, other = np.where(p > q, j[:, None], i[:, None]), np.where(p > q, i[:, None], j[:, None])
    away = points[other] - points[one]
    step = lambda turn: np.floor(turn * BEARINGS / (2 * np.pi)).astype(np.int64) % BEARINGS
    bearing, turn = step(np.arctan2(away[..., 0], away[..., 1]) - angle[one]), step(angle[other] - angle[one])
    length = np.minimum(np.log(np.maximum(np.hypot(away[..., 0], away[..., 1]), 1.0)) / np.log(LENGTHS), 15).astype(np.int64)
    return (((np.arange(TABLES) << 4 | bearing) << 4 | turn) << 4 | length) << 2 * PIECE | np.minimum(p, q) << PIECE | np.maximum(p, q)


def keys_of(marks: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """The distinct table keys of an image with these corners."""
    keys = [np.empty(0, np.int64)]
    for level in np.unique(spots & 255):
        own = spots & 255 == level
        spot = spots[own]
        points = (np.stack([spot >> 16 & (1 << 24) - 1, spot >> 40], axis=1) / 8 + 0.5) / RATIO**level - 0.5
        keys.append(pair_keys(points, (spot >> 8 & 255) * (2 * np.pi / FINE), marks[own]).ravel())
    return np.unique(np.concatenate(keys))


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marks and spots of an image's corners."""
    tests, marks, spots = chosen_tests(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size, points, angle, difference in contrasts(image, tests[:MARK]):
        marks.append((difference < 0) @ (1 << np.arange(MARK)))
        turn = np.rint(angle * FINE / (2 * np.pi)).astype(np.int64) % FINE
        y, x = np.rint(8 * np.maximum((points.T + 0.5) * size - 0.5, 0)).astype(np.int64)
        spots.append(x << 40 | y << 16 | turn << 8 | round(np.log(size) / np.log(RATIO)))
    return np.concatenate(marks), np.concatenate(spots)


def described(images: DataFrame) -> DataFrame:
    """(image_id, digest, area, marks, spots) of ``images`` (image_id, width, height, pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                digests, areas, corners = [], [], []
                for w, h, data in zip(*(part.column(c) for c in ("width", "height", "pixels")), strict=True):
                    w, h, data = w.as_py(), h.as_py(), data.as_py()
                    fits = data is not None and w and h and w > 0 and h > 0 and len(data) == w * h
                    digests.append(hashlib.sha256(b"%d,%d," % (w, h) + data).digest() if fits else None)
                    areas.append(w * h if fits else 0)
                    corners.append(describe(np.frombuffer(data, np.uint8).reshape(h, w) if fits else np.empty((0, 0))))
                lists = [pa.array(list(column), pa.list_(pa.int64())) for column in zip(*corners, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("image_id"), pa.array(digests, pa.binary()), pa.array(areas, pa.int64()), *lists], names=["image_id", "digest", "area", "marks", "spots"])

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, f"image_id long, digest binary, area long, {CORNERS}")


def keyed(corners: DataFrame) -> DataFrame:
    """(image, bucket), distinct for each row of ``corners`` (image, marks, spots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                marks, spots = (part.column(n) for n in ("marks", "spots"))
                keys = [keys_of(*(c[row].values.to_numpy(zero_copy_only=False) for c in (marks, spots))) for row in range(len(part))]
                images = np.repeat(part.column("image").to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(images, pa.int64()), pa.array(np.concatenate(keys), pa.int64())], names=["image", "bucket"])

    return corners.select("image", "marks", "spots").mapInArrow(run, "image long, bucket long")


def nearest_corners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the nearest mark in ``b`` to every one in ``a`` that has one within ``BITS`` bits."""
    near, bits = np.zeros(len(a), int), np.full(len(a), BITS + 1)
    step = max(1, 2_000_000 // max(len(b), 1))
    for at in range(0, len(a) if len(b) else 0, step):
        apart = np.bitwise_count(a[at : at + step, None] ^ b[None, :])
        near[at : at + step], bits[at : at + step] = apart.argmin(axis=1), apart.min(axis=1)
    i = np.flatnonzero(bits <= BITS)
    return i, near[i]


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], side: float) -> int:
    """The most matched corners, at different places of both images, that agree on one transformation.

    Rotations and scales fall into pairs of neighbouring steps, shifts into cells; all of them on two grids
    half a bin apart, so agreeing corners share a bin of some grid.  Images are (marks, spots); ``side``: the second one's.
    """
    i, j = nearest_corners(a[0], b[0])
    if len(i) < VOTES:
        return 0
    p, q = a[1][i], b[1][j]
    turn, level = ((q >> 8 & 255) - (p >> 8 & 255) + FINE // TURNS // 2) // (FINE // TURNS) % TURNS, (q & 255) - (p & 255)
    (ax, ay), (bx, by) = ((s >> 40, s >> 16 & (1 << 24) - 1) for s in (p, q))
    place = [x // 24 << 32 | y // 24 for x, y in ((ax, ay), (bx, by))]  # eighths of pixels
    ax, ay, bx, by = (c / 8 for c in (ax, ay, bx, by))
    cell, most = max(SHIFT, PART * side), 0
    for g_turn, g_level in itertools.product((0, 1), (0, 1)):
        turns, levels = (turn + g_turn) // 2 % (TURNS // 2), (level + g_level) // 2
        alike = turns * 512 + levels + 256  # rotation and scale; few bins have enough corners for the shifts to matter
        crowded = np.bincount(alike)[alike] >= max(VOTES, most + 1)
        if not crowded.any():
            continue
        bins, x, y, u, v, p, q = (c[crowded] for c in (alike, ax, ay, bx, by, *place))
        angle = 2 * np.pi * (2 * turns[crowded] + 0.5 - g_turn) / TURNS
        scale = RATIO ** (2 * levels[crowded] + 0.5 - g_level)
        tx = u - scale * (np.cos(angle) * x - np.sin(angle) * y)
        ty = v - scale * (np.sin(angle) * x + np.cos(angle) * y)
        for gx, gy in itertools.product((0.0, 0.5), (0.0, 0.5)):
            shifted = np.stack([bins, np.floor(tx / cell + gx).astype(int), np.floor(ty / cell + gy).astype(int)], axis=1)
            _, bin_no = np.unique(shifted, axis=0, return_inverse=True)
            counts = [np.bincount(np.unique(np.stack([bin_no.ravel(), spot], axis=1), axis=0)[:, 0]) for spot in (p, q)]
            most = max(most, int(np.minimum(*counts).max()))
    return most


def are_copies(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], side: float) -> bool:
    """Whether enough corners agree."""
    return agreeing(a, b, side) >= max(VOTES, VOTING * min(len(a[0]), len(b[0])))


def compared(facts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(image, area, marks, spots): what images are verified by; those with ``repeated`` (image_id) ids have the corners of all their pictures."""
    own = facts.where("size(spots) > 0").select(F.col("image_id").alias("image"), "digest", "area", "marks", "spots")
    repeated = small(repeated.withColumnRenamed("image_id", "image"))
    pictures = own.join(repeated, "image", "left_semi").groupBy("image", "digest").agg(F.first(F.struct("area", "marks", "spots")).alias("p"))
    pictures = pictures.groupBy("image").agg(F.max("p.area").alias("area"), *[F.flatten(F.collect_list(f"p.{n}")).alias(n) for n in ("marks", "spots")])
    return own.join(repeated, "image", "left_anti").select(pictures.columns).union(pictures)


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b), a < b, whose corners agree."""
    side = lambda which: held.select(F.col("image").alias(which), F.struct("area", "marks", "spots").alias(f"{which}_corners"))

    def corners(column: pa.StructArray, row: int) -> tuple[np.ndarray, np.ndarray]:
        marks, spots = (column.field(n)[row].values.to_numpy(zero_copy_only=False) for n in ("marks", "spots"))
        return marks, spots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("a_corners"), batch.column("b_corners")
            sides = np.sqrt(other.field("area").to_numpy())
            fine = [are_copies(corners(one, row), corners(other, row), float(sides[row])) for row in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_corners", "b_corners")
    return saved(met.mapInArrow(run, "a long, b long"), "links")


def copy_links(rows: DataFrame, pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join the images of ``rows`` (bucket, image, area), distinct, and of buckets of two, ``pairs``, into classes.

    Buckets only nominate pairs of images: a bucket's largest image meets all others;
    then, round by round, up to ``ROUND`` of the images outside the bucket's main class meet those of other classes, until none is left.
    A pair is verified once, with all corners of both, so its link doesn't depend on the other images there.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    rows, sizes = salted(rows.withColumn("done", F.lit(False)), "image")
    rows = saved(rows, "buckets")
    top = rows.groupBy("bucket").agg(F.max(F.struct("area", (-F.col("image")).alias("minus"))).alias("top"))
    top = top.select("bucket", (-F.col("top.minus")).alias("pivot"))
    met = to_bucket(rows, top, sizes).where("image <> pivot")
    tried = saved(met.select(*pair("pivot", "image")).union(pairs).distinct(), "pairs")
    found = verified(tried, held)
    while True:
        classes = components(found).withColumnsRenamed({"node": "image", "root": "class"})
        rows = rows.drop("class").join(classes, "image", "left").withColumn("class", F.coalesce("class", "image"))
        counts = rows.groupBy("bucket", "class").agg(F.count("*").alias("n"))
        main = counts.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
        rows = saved(to_bucket(rows, main.select("bucket", F.col("main.class").alias("main")), sizes), "open")
        chosen = first_rows(rows.where("class <> main AND NOT done"), [F.desc("area"), F.col("image")], ROUND)
        chosen = saved(chosen.select("bucket", F.col("image").alias("x"), F.col("class").alias("cx")), "chosen")
        if chosen.isEmpty():
            return found
        met = to_bucket(rows, chosen, sizes).where("class <> cx").select(*pair("x", "image")).distinct()
        fresh = saved(met.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried, found = tried.union(fresh), found.union(verified(fresh, held))
        went = chosen.select("bucket", F.col("x").alias("image"), F.lit(True).alias("went"))
        rows = rows.drop("main").join(went, ["bucket", "image"], "left").withColumn("done", F.col("done") | F.coalesce("went", F.lit(False))).drop("went")


def image_copies(images: DataFrame) -> DataFrame:
    """(image_id, class_id, n_corners) for each row of ``images``."""
    facts = saved(described(images), "described")
    equal = facts.where("digest IS NOT NULL").groupBy("digest").agg(F.min("image_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = small(saved(equal.select("digest", "first"), "equal"))
    rep = F.coalesce("first", "image_id")
    corners = F.size("spots").cast("long").alias("n_corners")
    member = saved(facts.select("image_id", "digest", "area", corners).join(equal, "digest", "left").select("image_id", rep.alias("rep"), "area", "n_corners"), "member")
    repeated = saved(member.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select("image_id"), "repeated")
    reps = facts.join(equal, "digest", "left").where(F.col("image_id") == rep).select(F.col("image_id").alias("image"), "marks", "spots")
    rows = keyed(reps.where("size(spots) > 1"))
    shared = rows.groupBy("bucket").agg(F.min("image").alias("a"), F.max("image").alias("b"), F.count("*").alias("n")).where("a <> b")
    shared = saved(shared, "shared")
    pairs = shared.where("n = 2").select("a", "b")
    area = member.where("image_id = rep").groupBy(F.col("image_id").alias("image")).agg(F.max("area").alias("area"))
    crowds = rows.join(small(shared.where("n > 2").select("bucket")), "bucket").distinct().join(area, "image")
    links = copy_links(crowds, pairs, compared(facts, repeated))
    several = member.groupBy("image_id").agg(F.min("rep").alias("one"), F.max("rep").alias("other")).where("one <> other").select("image_id")
    ties = member.join(several, "image_id").select(F.col("image_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.union(ties))
    names = roots.groupBy("root").agg(F.min("node").alias("class_id"))
    classes = roots.join(names, "root").select(F.col("node").alias("rep"), "class_id")
    done = member.join(classes, "rep", "left")
    class_id = F.when(F.col("image_id").isNotNull(), F.coalesce("class_id", "rep"))
    return done.select("image_id", class_id.alias("class_id"), "n_corners")


def render(vector: list[float], size: int = SIZE) -> np.ndarray:
    """A picture of a vector: its components as a smooth field, under shapes seeded by them."""
    v = np.nan_to_num(np.array([x or 0.0 for x in vector], float), posinf=0.0, neginf=0.0)
    seed = int.from_bytes(hashlib.sha256(v.tobytes()).digest()[:8], "little")
    side = max(2, int(np.sqrt(len(v))))
    grid = np.resize(v if len(v) else np.zeros(1), (side, side))
    at = np.linspace(0, side - 1.001, size)
    i, f = at.astype(int), at - at.astype(int)
    rows = grid[i] * (1 - f)[:, None] + grid[i + 1] * f[:, None]
    out = 128 + 120 * (rows[:, i] * (1 - f) + rows[:, i + 1] * f) / (np.abs(grid).max() + 1e-9)
    rng = np.random.default_rng(seed)
    for _ in range(18):
        y, x, h, w = rng.integers(0, size, 2).tolist() + rng.integers(5, size // 3, 2).tolist()
        out[y : y + h, x : x + w] = 0.35 * out[y : y + h, x : x + w] + 0.65 * rng.integers(0, 256)
    out += box(rng.normal(0, 14, (size, size)), 1)
    return np.clip(out, 0, 255).astype(np.uint8)


def edit(image: np.ndarray, kind: int, seed: int) -> np.ndarray:
    """A crop, a brighter and partly covered copy, a quarter turn, a crop to half of each side, or a copy of two thirds the size."""
    rng = np.random.default_rng(seed)
    n = len(image)
    if kind == 3:
        y, x = rng.integers(0, n - n // 2, 2)
        return np.ascontiguousarray(image[y : y + n // 2, x : x + n // 2])
    if kind == 4:
        return np.clip(np.rint(resized(summed(image), 1.5)), 0, 255).astype(np.uint8)
    if kind == 0:
        y, x = rng.integers(0, n // 5, 2)
        return np.ascontiguousarray(image[y : y + n * 4 // 5, x : x + n * 4 // 5])
    if kind == 1:
        out = (image * 0.85 + 25).astype(np.uint8)
        y, x = rng.integers(0, n - 12, 2)
        out[y : y + 12, x : x + 12] = 200
        return out
    return np.ascontiguousarray(np.rot90(image))


def pictures(embeddings: DataFrame) -> DataFrame:
    """A media table made of ``embeddings``: a picture of each vector.

    Every row whose id ends in 3 shows an edited copy of its predecessor's picture instead, so
    that the copies in the table are known.
    """
    given = embeddings.select(F.col("vec_id").alias("image_id"), "embedding")
    before = given.where("image_id % 10 = 2").groupBy((F.col("image_id") + 1).alias("image_id")).agg(F.min("embedding").alias("before"))
    # drawing takes longer than reading: a part for each shuffle partition, however few bytes they are
    rows = given.join(before, "image_id", "left").repartition(int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.slice(begin, 1000)
                shape, data = [], []
                for i, own, before in zip(*(part.column(c).to_pylist() for c in ("image_id", "embedding", "before")), strict=True):
                    image = edit(render(before), i // 10 % 5, i) if before is not None else render(own) if own is not None else None
                    shape.append(image.shape if image is not None else (None, None))
                    data.append(image.tobytes() if image is not None else None)
                yield pa.RecordBatch.from_arrays([part.column("image_id"), pa.array([s[1] for s in shape], pa.int32()), pa.array([s[0] for s in shape], pa.int32()), pa.array(data, pa.binary())], names=["image_id", "width", "height", "pixels"])

    return rows.mapInArrow(run, "image_id long, width int, height int, pixels binary")


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Classes of copies among the pictures of all embeddings."""
    return image_copies(pictures(table(spark, sf_dir, "embeddings")))

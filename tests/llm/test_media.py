"""Copies among images, against the edits that are known and against all pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import buckets, media

IMAGES = "image_id long, width int, height int, pixels binary"


def row(i, a):
    return (i, a.shape[1], a.shape[0], bytearray(a.tobytes()))


def picture(rng, size=80):
    return media.render(rng.normal(size=64).tolist(), size)


def test_image_copies(spark, sf):
    got = {r["image_id"]: r["class_id"] for r in media.op7_media(spark, sf).collect()}
    for kind in range(5):
        edits = [i for i in got if i % 10 == 3 and i // 10 % 5 == kind]
        assert np.mean([got[i] == got[i - 1] for i in edits]) >= 0.9, kind
    assert all(got[i] == i for i in got if i % 10 != 3)


def smaller(image):
    """Two thirds the size, between pixels."""
    at = (np.arange(len(image) * 2 // 3) + 0.5) * 1.5 - 0.5
    i = at.astype(int)
    f, j = at - i, np.minimum(i + 1, len(image) - 1)
    rows = image[i] * (1 - f)[:, None] + image[j] * f[:, None]
    return np.clip(np.rint(rows[:, i] * (1 - f) + rows[:, j] * f), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("size,pictures", [(80, 20), (160, 10), (320, 5), (640, 2)])
def test_recall_of_crops_and_resized_copies(spark, size, pictures):
    rng = np.random.default_rng(size)
    data, edits = [], {}
    for i in range(pictures):
        image = picture(rng, size)
        data.append(row(100 * i, image))
        copies = [media.edit(image, 3, int(rng.integers(1e6))), media.edit(image, 4, 0), smaller(image), np.ascontiguousarray(np.rot90(smaller(image)))]
        for k, copy in enumerate(copies, 1):
            data.append(row(100 * i + k, copy))
            edits[100 * i + k] = 100 * i
    df = spark.createDataFrame(data, IMAGES).repartition(8)
    got = {r["image_id"]: r["class_id"] for r in media.image_copies(df).collect()}
    for k in (1, 2, 3, 4):
        assert np.mean([got[i] == got[o] for i, o in edits.items() if i % 100 == k]) >= 0.9, k
    assert len({got[100 * i] for i in range(pictures)}) == pictures


def test_like_all_pairs(spark):
    rng = np.random.default_rng(5)
    images = {}
    for i in range(14):
        image = picture(rng)
        images[10 * i] = image
        for k in range(i % 4):
            images[10 * i + k + 1] = media.edit(image, int(rng.integers(5)), int(rng.integers(1e6)))
    told = {}
    for i, a in images.items():
        told[i] = media.describe(a)
    group = {i: i for i in images}
    for a, b in itertools.combinations(sorted(images), 2):
        if media.are_copies(told[a], told[b], float(np.sqrt(images[b].size))):
            group = {i: min(group[a], group[b]) if g in (group[a], group[b]) else g for i, g in group.items()}
    got = {r["image_id"]: r["class_id"] for r in media.image_copies(spark.createDataFrame([row(i, a) for i, a in images.items()], IMAGES)).collect()}
    assert np.mean([got[i] == group[i] for i in images]) >= 0.95
    assert all(group[i] // 10 == i // 10 for i in images)


def test_image_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(buckets, "PART", 4)
    rng = np.random.default_rng(0)
    one = picture(rng)
    crops = [(20 + k, media.edit(one, 0, k)) for k in range(24)]
    data = [row(1, one), row(2, one), row(3, np.rot90(one).copy()), (4, None, None, None), (5, 3, 3, bytearray(b"x")), row(6, np.zeros((40, 40), np.uint8)), row(7, one[:5, :5].copy()), row(7, one[:5, :5].copy()), (None, 80, 80, bytearray(one.tobytes()))]
    other = picture(rng)
    data += [row(8, other), row(8, media.edit(one, 0, 5)), row(9, media.edit(other, 2, 0))]  # an id with two pictures ties their classes
    df = spark.createDataFrame(data + [row(i, a) for i, a in crops], IMAGES).withColumns({n: F.lit(1) for n in ("area", "digest", "keys", "spots", "bucket", "salt")})
    got = [(r["image_id"], r["class_id"]) for r in media.image_copies(df).collect()]
    by = dict(got)
    assert len(got) == len(data) + len(crops)
    assert by[1] == by[2] == by[3] == by[8] == by[9] == 1 and by[4] == 4 and by[5] == 5 and by[6] == 6 and by[7] == 7 and by[None] is None
    assert np.mean([by[i] == 1 for i, _ in crops]) > 0.9
    assert media.image_copies(df.limit(0)).count() == 0


def test_links_do_not_depend_on_other_images(spark):
    rng = np.random.default_rng(2)
    one, other = picture(rng), picture(rng)
    few = {1: one, 2: media.edit(one, 3, 1)}
    both = other.copy()
    both[:40, :40] = one[:40, :40]
    links = lambda images: {r["image_id"]: r["class_id"] for r in media.image_copies(spark.createDataFrame([row(i, a) for i, a in images.items()], IMAGES)).collect()}
    assert links(few)[2] == 1
    more = links(few | {3: np.tile(both, (2, 2)), 4: other})
    assert more[2] == more[1]


def test_salts_keep_buckets_whole(spark, monkeypatch):
    monkeypatch.setattr(buckets, "PART", 5)
    rows = spark.range(200).selectExpr("id % 7 AS bucket", "id AS item").union(spark.range(90).selectExpr("100L AS bucket", "id AS item"))
    dealt, sizes = buckets.salted(rows, "item")
    facts = spark.createDataFrame([(100, "x"), (100, "y"), (3, "z")], "bucket long, fact string")
    assert buckets.to_bucket(dealt, facts, sizes).groupBy("fact").count().collect().__len__() == 3
    assert buckets.to_bucket(dealt, facts, sizes).where("fact = 'y'").count() == 90
    first = buckets.first_rows(dealt, [F.desc("item")], 3).where("bucket = 100").select("item").collect()
    assert sorted(r["item"] for r in first) == [87, 88, 89]


def test_neighbours_are_the_nearest_of_all():
    rng = np.random.default_rng(4)
    points = rng.permutation(np.stack(np.meshgrid(np.arange(0, 90, 3.0), np.arange(0, 120, 3.0)), axis=-1).reshape(-1, 2))[:700] + rng.uniform(0, 1, (700, 2))
    apart = np.square(points[:, None] - points[None]).sum(axis=-1) + np.diag(np.full(700, np.inf))
    nearest = np.argsort(apart, axis=1)[:, : media.NEIGHBOURS]
    want = {(min(i, j), max(i, j)) for i, row in enumerate(nearest.tolist()) for j in row}
    assert set(zip(*(a.tolist() for a in media.neighbours(points)), strict=True)) == want
    assert len(media.neighbours(points[:1])[0]) == 0


def test_few_pictures_share_a_key_by_chance():
    rng = np.random.default_rng(6)
    keys = [media.keys_of(*media.describe(picture(rng))) for _ in range(150)]
    found = np.unique(np.concatenate(keys), return_counts=True)[1]
    assert (found > 1).sum() <= 2  # of 11,175 pairs of pictures
    assert all(len(np.unique(k)) == len(k) for k in keys)


def test_watermarked_pictures_meet_in_one_bucket(spark, monkeypatch):
    """Pictures that all show one mark are one class, whatever their number; a large bucket is dealt over tasks."""
    monkeypatch.setattr(buckets, "PART", 4)
    rng = np.random.default_rng(9)
    mark = picture(rng)[:36, :36]
    images = []
    for i in range(30):
        image = picture(rng)
        image[-36:, -36:] = mark
        images.append(row(i, image))
    got = media.image_copies(spark.createDataFrame(images, IMAGES).repartition(4)).collect()
    assert np.mean([r["class_id"] == 0 for r in got]) > 0.9

"""Intermediate tables in the shared folder."""

import os

from lorekeep.sources import tables


def test_swept_deletes_what_was_written(spark):
    other = spark.newSession()
    tables.swept(spark)
    df = tables.saved(spark.range(3), "some")
    path = tables.new_path(other, "never-written")
    assert df.count() == 3
    here = tables.shared_dir(spark).removeprefix("file://")
    assert any(n.startswith("some-") for n in os.listdir(here))
    assert tables.swept(spark) == 2 and not any(n.startswith("some-") for n in os.listdir(here)) and path
    assert tables.swept(spark) == 0

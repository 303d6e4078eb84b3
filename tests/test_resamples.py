"""Resamples of exactly n rows, and subtitle files without blank lines."""

import numpy as np
from pyspark.sql import functions as F

from corpusframe.operators import evaluation_runs
from corpusframe.sources import readers


def test_every_resample_has_exactly_n_rows_however_rows_are_cut(spark):
    rng = np.random.default_rng(3)
    values = rng.gamma(2.0, 1.0, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(900, None)], "id int, v double").repartition(5)
    for cell_rows in (1000, 37):
        got = evaluation_runs.resamples(df, "v", "id", 600, cell_rows=cell_rows).toPandas()
        assert len(got) == 600 and set(got.n) == {400}
        means = got.total / 400
        # as numpy's own resamples: mean of means, and their spread
        own = rng.choice(values, (600, 400)).mean(1)
        assert abs(means.mean() - values.mean()) < 5 * values.std() / (400 * 600) ** 0.5 and abs(means.std() / own.std() - 1) < 0.15
        again = evaluation_runs.resamples(df.repartition(2), "v", "id", 600, cell_rows=cell_rows).toPandas()
        assert np.allclose(np.sort(got.total), np.sort(again.total))


def test_interval_is_that_of_numpy_resamples(spark):
    values = np.random.default_rng(5).random(120) ** 3
    r = evaluation_runs.bootstrap_interval(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double"), "v", "id").first()
    own = np.sort(np.random.default_rng(6).choice(values, (2000, 120)).mean(1))
    spread = own.std()
    assert r.n == 120 and abs(r.mean - values.mean()) < 1e-12 and abs(r.low - own[50]) < 0.15 * spread and abs(r.high - own[1950]) < 0.15 * spread
    one = evaluation_runs.bootstrap_interval(spark.createDataFrame([(1, 0.5)], "id int, v double"), "v", "id").first()
    none = evaluation_runs.bootstrap_interval(spark.createDataFrame([], "id int, v double"), "v", "id").first()
    assert tuple(one) == (1, 0.5, 0.5, 0.5) and tuple(none) == (0, None, None, None)


def test_cues_without_blank_lines_and_with_short_stamps(spark):
    text = "﻿WEBVTT\r\n\r\n1\r\n1:02:03.5 --> 1:02:04,250\r\n<b>first</b> line\r\n  second line \r\n2\r\n00:00:05,000 --> 00:00:06.000\r\nright after\r\n\r\nstill the same times\r\n\r\n00:00:07,000 --> 00:00:08,000\r\n<i></i>\r\n42\r\nno time before this"
    files = spark.createDataFrame([("a", text), ("b", "text without any time"), ("c", None), ("d", "")], "path string, text string")
    got = [tuple(r) for r in readers.subtitle_cues(files).orderBy("path", "cue").collect()]
    assert got == [("a", 0, 3723.005, 3724.25, "first line second line"), ("a", 1, 5.0, 6.0, "right after"), ("a", 2, 5.0, 6.0, "still the same times"), ("a", 3, 7.0, 8.0, "no time before this")]
    assert readers.subtitle_blocks(readers.subtitle_cues(files), 20).select(F.count("*")).first()[0] == 3

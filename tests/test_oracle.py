"""Queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from pixelframe.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Those of one module each that are quick; the driver compares all of them.
SOME = ["histogram", "clip_fractions", "white_patch", "wb_gains", "band_tone", "curve_lut", "saturation", "crop_pixels", "lut3d_trilinear", "pending_work", "job_status", "batch_summary", "preset_params_long", "layer_order", "active_layers", "mask_stats", "class_probs", "rank_detections", "nearest_landmarks", "gaussian_smooth", "dilate", "proxy_downsample", "mask_resize", "grade_masked", "ledger_scan", "job_scan", "lut_catalog", "mask_archive", "apply_presets", "gaussian_weight", "merge_views", "rgb_hsv8", "rgb_lab8", "layer_stack", "label_mask", "grade_global", "gaussian_smooth_wide", "dilate_wide", "connected_components", "open_close", "stream_jobs", "stream_new_images", "tint", "effect_masks", "nearest_landmarks_crowd", "scene_masks", "grade_background", "image_pixels"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    cursor = db.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE_SQL[name]})")
    assert found == sorted(map(repr, cursor.fetchall()))


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_long_computations_are_dealt_out(spark):
    """One small file's rows are worked on by many tasks."""
    from pixelframe.plans import pixel_queries

    assert pixel_queries.wb_invert(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4

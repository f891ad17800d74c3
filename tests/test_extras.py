"""Colours, members, folders by three ways, cached maps, moved pictures, saved fits."""

import numpy as np
import pytest

from airledger.functions import aqi
from airledger.operators import abstain, calibrate, pictures
from airledger.sources.bundle import load_fit, save_fit
from airledger.sources.feeds import find_folders, folder_rollup
from pyspark.sql import functions as F


def test_colours(spark):
    rows = spark.createDataFrame([(0.0,), (50.0,), (50.5,), (151.0,), (900.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(aqi.category_colour(F.col("x"))).collect()] == ["#00e400", "#00e400", "#ffff00", "#ff0000", "#7e0023", None]


def test_members_and_mirror_images(spark):
    rows = spark.createDataFrame([(1, 10.0, 4.0), (1, 40.0, 8.0), (2, 5.0, None)], "id int, q double, p double")
    got = {r["id"]: (r["q"], r["p"]) for r in calibrate.averaged_outputs(rows, ["id"], ["q"], ["p"]).collect()}
    assert got[1] == (pytest.approx(20), 6) and got[2] == (pytest.approx(5), None)


def test_saved_fit(spark, tmp_path):
    assert load_fit(spark, str(tmp_path / "none")) is None
    save_fit(spark, str(tmp_path / "fit"), mean=np.arange(3.0), precision=np.eye(3))
    fit = load_fit(spark, str(tmp_path / "fit"))
    assert fit["mean"].tolist() == [0, 1, 2] and (fit["precision"] == np.eye(3)).all()


def test_folders(spark):
    files = [f"/in/up/fogset/a/{i}.jpg" for i in range(5)] + [f"/in/fogset-old/decoy/{i}.jpg" for i in range(9)] + [f"/in/misc/{k}/{i}.jpg" for k in ("Kitchen", "bedroom", "car") for i in range(2)] + ["/in/n1/x/1.jpg", "/in/n2/1.jpg"]
    tree = folder_rollup(spark.createDataFrame([(f,) for f in files], "path string"))
    light = spark.createDataFrame([("/in/n1", 0.1), ("/in/n2", 0.15), ("/in/misc", 0.5)], "folder string, brightness double")
    words = {"fog": ("fogset",), "rooms": ("mit",), "night": ("exdark",), "none": ("zzz",)}
    got = {r["name"]: (r["folder"], r["found_by"]) for r in find_folders(tree, words, {"rooms": ("kitchen", "bedroom")}, 2, ("old",), ("night", light, 0.2)).collect()}
    assert got == {"fog": ("/in/up/fogset", "keyword"), "rooms": ("/in/misc", "signature"), "night": ("/in/n1", "darkness")}
    assert find_folders(tree.limit(0), words, {"rooms": ("kitchen",)}).collect() == []


def test_cached_maps_and_moves(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 8, 8, np.floor(rng.random(192) * 256).clip(0, 255).tolist()) for i in range(3)]
    rows = [(i, h, w, [v / 255 for v in x]) for i, h, w, x in rows]
    table = spark.createDataFrame(rows, "image int, height int, width int, rgb array<double>")
    cache = pictures.picture_features(table, size=8, patch=3).select("image", "maps")
    fresh = {r["image"]: np.array(r["tensor"]) for r in pictures.five_channel_table(table, size=8, patch=3).collect()}
    cached = {r["image"]: np.array(r["tensor"]) for r in pictures.five_channel_cached(table, cache, size=8).collect()}
    assert fresh.keys() == cached.keys() and all(abs(fresh[i] - cached[i]).max() < 0.025 for i in fresh)  # maps are kept in 8 bits
    with pytest.raises(ValueError):
        pictures.five_channel_cached(table, cache, size=16)
    with pytest.raises(LookupError):
        pictures.five_channel_cached(table, cache.where("image < 2"), size=8)
    x = rng.random((5, 8, 8))
    assert np.allclose(pictures.moved(x, False, 0, 0, 0, 1, 1), x) and np.allclose(pictures.moved(x, True, 0, 0, 0, 1, 1), x[:, :, ::-1])
    assert np.allclose(pictures.moved(x, False, 90, 0, 0, 1, 1), np.rot90(x, 1, (1, 2))) or np.allclose(pictures.moved(x, False, 90, 0, 0, 1, 1), np.rot90(x, -1, (1, 2)))
    tensors = pictures.five_channel_table(table, size=8, patch=3)
    a, b, c = ({r["image"]: r["tensor"] for r in pictures.augmented(tensors, 8, epoch=e).collect()} for e in (0, 0, 1))
    assert a == b and a != c and {len(t) for t in a.values()} == {320}


def test_float_rgb():
    assert pictures.float_rgb(np.array([[0, 255], [51, 102]])).tolist() == [[[0] * 3, [1] * 3], [[0.2] * 3, [0.4] * 3]]
    assert pictures.float_rgb(np.full((2, 2, 3), 0.5)).max() == 0.5


def test_haze_colour_ties_go_to_the_first():
    rgb = np.zeros((2, 3, 3))
    rgb[0, 2], rgb[1, 0] = (0.9, 0.2, 0.2), (0.2, 0.9, 0.2)
    assert pictures.haze_colour(rgb, np.array([[0.1, 0.1, 0.5], [0.5, 0.1, 0.1]]), 0.4).tolist() == [0.9, 0.2, 0.2]


def test_near_far_and_shift(spark):
    rows = spark.createDataFrame([(0.1 * k, "id") for k in range(20)] + [(1.5, "near"), (5.0, "near")], "s double, kind string")
    got = {r["subset"]: r for r in abstain.ood_summary(rows, "s", "kind").collect()}
    assert set(got) == {"all", "near"} and got["near"]["n_ood"] == 2  # no far rows, no such row
    one = abstain.station_shift(rows.where("kind = 'id'"), rows.where("kind = 'near'"), "s").first()
    assert one["holdout_rate"] == 0.05 and one["unseen_rate"] == 0.5 and one["excess"] == pytest.approx(0.45)
    none = abstain.station_shift(rows.limit(0), rows, "s").first()
    assert none["unseen_rate"] == 0  # nothing to judge by: nothing is refused

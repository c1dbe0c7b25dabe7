import json

import pytest
from pyspark.sql import functions as F

from starloom.sources import records
from starloom.streaming import registration

GOOD = {"matcher": "quad", "success": True, "scale": 1.1, "R_yx": [[1, 0], [0, 1]], "t_um_yx": [1, 2], "pixel_size_crop_um": 0.5, "pixel_size_full_um": 0.5, "future_field": 1}


def test_scan_numbers_lines_and_keeps_unknown_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=1))
    (tmp_path / "b.jsonl").write_text(json.dumps(GOOD) + "\n\n" + json.dumps(GOOD) + "\n[1]\n")
    rows = records.scan(spark, str(tmp_path), records.FIELDS_2D).collect()
    assert sorted((r._source_kind, r._line) for r in rows) == [("json", 0), ("jsonl", 1), ("jsonl", 3)]
    assert all("future_field" in r._text and r.scale == 1.1 for r in rows)


@pytest.mark.parametrize(
    ("change", "n"),
    [({}, 0), ({"success": False}, 1), ({"pixel_size_crop_um": 0}, 1), ({"t_um_yx": [1]}, 1), ({"R_yx": None}, 1), ({"scale": -1, "R_yx": [[1]]}, 2), ({"bbox_full_px_y0y1x0x1": [4, 2, 0, 1]}, 1)],
)
def test_problems(spark, change, n):
    rows = spark.createDataFrame([(json.dumps(GOOD | change), "x", 1)], "_text string, _source_path string, _line int")
    parsed = records.parsed(rows, records.FIELDS_2D)
    assert parsed.select(F.size(records.problems_2d()).alias("n")).first()["n"] == n


def test_strict_mode_names_the_line(spark):
    rows = spark.createDataFrame([(json.dumps({"best_scale": 1.0}), "some/file", 4)], "_text string, _source_path string, _line int")
    found = records.canonical_3d(records.parsed(rows, records.FIELDS_3D))
    with pytest.raises(Exception, match="some/file line 4"):
        records.validated(found, records.problem_3d()).collect()


def test_stream_matches_sets_once(spark, tmp_path):
    reference = spark.createDataFrame([(k, float(k * 10), 0.0) for k in range(9)], "pid long, y double, x double")
    (tmp_path / "in").mkdir()
    for s in "ab":
        (tmp_path / "in" / f"{s}.json").write_text("\n".join(json.dumps({"set_id": s, "pid": k, "y": k * 10.0 + (5 if s == "b" else 0.1), "x": 0.0}) for k in range(4)))
    act = registration.append_results(str(tmp_path / "out"), reference, 1.0)
    for _ in range(2):  # a second run finds nothing new
        registration.register_stream(registration.stream_points(spark, str(tmp_path / "in")), act, str(tmp_path / "state")).awaitTermination()
    got = {r.set_id: (r.n, r.n_inliers) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"a": (4, 4), "b": (4, 0)}

"""Every issue code of a submission, on literal lines."""

import json

import pytest

from tidemark.sources.submissions import CODES, validate


def line(video="a", ratio=(9, 16), predictions=(), **more):
    record = {"video_id": video, "predictions": list(predictions)} | ({"targetRatioWH": list(ratio)} if ratio is not None else {}) | more
    return json.dumps({k: v for k, v in record.items() if v != "gone"})


GOOD = {"frame": 1, "bboxes": [0, 0, 9]}
CASES = [
    ("{", ["invalid_json"]), ("[1]", ["invalid_record"]), ("3", ["invalid_record"]), ("  ", []), (line(video=7), ["missing_video_id"]), (line(video=""), ["missing_video_id"]), (line(video="gone"), ["missing_video_id"]), (line(video="zz"), ["unknown_video_id"]),
    (line(ratio=(9, 0)), ["invalid_target_ratio"]), (line(ratio=(9,)), ["invalid_target_ratio"]), (line(ratio=(1, 2, 3)), ["invalid_target_ratio"]), (line(ratio=(3, 4)), ["ratio_mismatch"]), (line(ratio=("9", "16.0")), []), (line(ratio=None, predictions=[GOOD]), []),
    (json.dumps({"video_id": "a"}), ["missing_predictions"]), (json.dumps({"video_id": "a", "predictions": {}}), ["missing_predictions"]), (line(predictions=[3, GOOD]), ["invalid_prediction"]),
    (line(predictions=[GOOD | {"frame": 1.5}]), ["non_integer_frame"]), (line(predictions=[GOOD | {"frame": True}]), ["non_integer_frame"]), (line(predictions=[{"bboxes": [0, 0, 9]}]), ["non_integer_frame"]), (line(predictions=[GOOD | {"frame": "1"}]), ["non_integer_frame"]),
    (line(predictions=[GOOD | {"frame": -1}]), ["negative_frame"]), (line(predictions=[GOOD | {"frame": 10}]), ["frame_out_of_range"]), (line(predictions=[GOOD, GOOD]), ["duplicate_frame"]), (line(predictions=[GOOD | {"frame": 2}, GOOD | {"frame": -1}, GOOD]), ["negative_frame", "non_ascending_order"]),
    (line(predictions=[GOOD | {"frame": 5}]), ["temporal_traceability_violation"]), (line(video="b", predictions=[GOOD | {"frame": 5}]), []), (line(predictions=[{"frame": 1}]), ["missing_bboxes"]), (line(predictions=[GOOD | {"bboxes": [0, 0]}]), ["invalid_bbox_shape"]),
    (line(predictions=[GOOD | {"bboxes": [0, 0, 1, 1]}]), ["invalid_bbox_shape"]), (line(predictions=[GOOD | {"bboxes": "abc"}]), ["invalid_bbox_shape"]), (line(predictions=[GOOD | {"bboxes": [0, 0.5, 9]}]), ["non_integer_bbox"]), (line(predictions=[GOOD | {"bboxes": [0, False, 9]}]), ["non_integer_bbox"]),
    (line(predictions=[GOOD | {"bboxes": [-1, 0, 9]}]), ["invalid_bbox_value"]), (line(predictions=[GOOD | {"bboxes": [0, 0, 0]}]), ["invalid_bbox_value"]), (line(predictions=[GOOD | {"bboxes": [92, 0, 9]}]), ["bbox_out_of_bounds"]), (line(predictions=[GOOD | {"bboxes": [0, 5, 9]}]), ["ratio_height_violation"]),
    (line(predictions=[GOOD | {"bboxes": [0, 4, 9]}]), []), (line(video="n", ratio=None, predictions=[GOOD | {"frame": 10**12, "bboxes": [5000, 5000, 9]}]), []),
]


@pytest.fixture(scope="module")
def tables(spark):
    index = spark.createDataFrame([("a", [9.0, 16.0]), ("b", [9.0, 16.0]), ("gone", [9.0, 16.0]), ("n", None)], "video_id string, ratio array<double>")
    sizes = spark.createDataFrame([("a", 100, 20, 10), ("b", 100, 20, 10), ("n", 0, -1, None)], "video_id string, width long, height long, frame_count long")
    return index, sizes, spark.createDataFrame([("a", 0), ("a", 1), ("a", 2)], "video_id string, frame long")


def test_each_line_has_its_codes(spark, tables):
    lines = spark.createDataFrame(list(enumerate((t for t, _ in CASES), 1)), "line long, text string")
    rows = validate(lines, *tables).collect()
    got = {}
    for r in rows:
        got.setdefault(r.line, []).append(r.code)
    for k, (text, want) in enumerate(CASES, 1):
        assert sorted(got.get(k, [])) == sorted(want), text
    assert got[0] == ["missing_video_line"] and next(r for r in rows if r.line == 0).video_id == "gone"
    assert {r.code for r in rows} == set(CODES)


def test_without_index_sizes_and_frames(spark):
    lines = spark.createDataFrame([(1, line(video="zz", ratio=None, predictions=[GOOD | {"frame": 10**9, "bboxes": [9999, 9999, 9]}])), (2, None)], "line long, text string")
    assert validate(lines).collect() == []
    assert validate(lines.limit(0)).count() == 0


def test_each_line_is_parsed_once(spark, tables):
    lines = spark.createDataFrame(list(enumerate((t for t, _ in CASES), 1)), "line long, text string")
    plan = validate(lines, *tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_broken_lines_do_not_meet_videos_without_a_name(spark, tables):
    """Names that are null are never found; broken lines, whatever their number, stay rows of their own."""
    index, sizes, allowed = tables
    nulls = spark.createDataFrame([(None, [9.0, 16.0])], index.schema)
    lines = spark.createDataFrame([(k, "{") for k in range(40, 45)] + [(50, line()), (51, line())], "line long, text string")
    got = sorted((r.line, r.video_id or "", r.code) for r in validate(lines, index.unionAll(nulls), sizes, allowed).collect())
    gone = [(0, v, "missing_video_line") for v in ("", "b", "gone", "n")]
    assert got == gone + [(k, "", "invalid_json") for k in range(40, 45)]


def test_manifest_against_its_files(spark, tmp_path):
    import hashlib

    from tidemark.sources.manifests import file_issues, manifest_issues, require_manifest

    (tmp_path / "a").mkdir()
    for name, data in {"a/x": b"one", "a/y": b"two!", "z": b"three"}.items():
        (tmp_path / name).write_bytes(data)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("1", "a/x", 3, digest(b"one").upper()), ("2", "a/y", 3, digest(b"two!")), ("3", "z", 5, digest(b"other")), ("4", "none", 1, None), ("5", "a/x", None, None)]
    df = spark.createDataFrame(rows, "id string, place string, bytes long, sha string")
    assert {tuple(r) for r in file_issues(spark, df, "id", "place", "bytes", str(tmp_path)).collect()} == {("2", "SIZE"), ("4", "NO_FILE"), ("5", "SIZE")}
    assert {tuple(r) for r in file_issues(spark, df, "id", "place", "bytes", str(tmp_path), "sha").collect()} == {("2", "SIZE"), ("3", "CONTENT"), ("4", "NO_FILE"), ("5", "SIZE")}
    one = df.where("id = '1'")
    assert require_manifest(one, file_issues(spark, one, "id", "place", "bytes", str(tmp_path), "sha"), 1) is one
    with pytest.raises(ValueError, match="instead of 2"):
        require_manifest(one, manifest_issues(one, "id"), 2)
    with pytest.raises(ValueError, match="DUPLICATE"):
        require_manifest(one, manifest_issues(one.unionAll(one), "id"))
    nulls = spark.createDataFrame([(None, None), (None, "s"), ("k", "s")], "id string, s string")
    assert {tuple(r) for r in manifest_issues(nulls, "id", "s", {"s": 2, "t": 1}).collect()} == {(None, "NULL_KEY", 2), ("null", "QUOTA", 1), ("t", "QUOTA", 0)}


def test_candidates_name_the_fault(spark):
    from tidemark.sources.manifests import split_candidates

    sha = "0" * 64
    aligned = [("v1", " TRAIN ", True, "", "dog"), ("v2", "train", False, None, "dog"), ("v3", "test", True, None, None)]
    kinds = ("canonical_video_id string, official_split string, passed boolean, actual_source_id string, category string", "canonical_video_id string, download_status string, sha256 string, relative_path string", "canonical_video_id string, original_video_id string, replacement_video_id string")

    def run(aligned, raw, seen):
        return [tuple(r) for r in split_candidates(*[spark.createDataFrame(x, k) for x, k in zip((aligned, raw, seen), kinds)]).collect()]

    raw = [("v1", "ok", sha, "p")]
    assert run(aligned, raw, []) == [("v1", "v1", "v1", None, "dog", "p", sha)]
    assert run(aligned, raw, [("v1", "o", "")]) == [("v1", "v1", "o", None, "dog", "p", sha)]
    for bad, fault in [
        ((aligned, [], []), "no raw row"), ((aligned, [("v1", "failed", sha, "p")], []), "download is not OK"), ((aligned, [("v1", "OK", "00", "p")], []), "no digest"), ((aligned, [("v1", "OK", sha, "")], []), "no path"), ((aligned, raw * 2, []), "two rows"),
        (([("v1", "train", True, None, "")], raw, []), "no category"), (([("", "train", True, None, "c")], raw, []), "no canonical_video_id"),
    ]:
        with pytest.raises(Exception, match=fault):
            run(*bad)

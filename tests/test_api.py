import json

import pytest

from gleaner.api import Store

GROUPS = "group_id long, group_type string, confidence double, recommended_file_id long, stable_key string"
ITEMS = "group_id long, file_id long, path string, action string, similarity double, quality double, size_bytes long, media_type string"


def test_decisions_outlive_a_rescan(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    groups = spark.createDataFrame([(1, "exact", 1.0, 1, "k1"), (2, "similar_text", 0.5, 3, "k2")], GROUPS)
    items = spark.createDataFrame([(1, 1, "a", "keep_recommended", 1.0, 0.9, 5, "text"), (1, 2, "b", "cleanup_candidate", 1.0, 0.8, 5, "text"), (2, 3, "c", "keep_recommended", 1.0, 0.7, 9, "text"), (2, 4, "D", "review_required", 0.9, 0.6, 7, "text")], ITEMS)
    s.replace(groups, items)
    assert [r.group_id for r in s.list_groups().collect()] == [1, 2]
    assert [r.group_id for r in s.list_groups(search="d").collect()] == [2]
    s.set_status(groups.where("group_id = 1"), "ignored")
    s.replace(groups, items)
    assert {r.group_id: r.status for r in s.read("groups").collect()} == {1: "ignored", 2: "pending"}
    assert s.summary().first().reclaimable_bytes == 7
    s.set_recommended(spark.createDataFrame([(2, 4)], "group_id long, file_id long"))
    assert {r.file_id: r.action for r in s.read("items").where("group_id = 2").collect()} == {3: "cleanup_candidate", 4: "keep_recommended"}
    with pytest.raises(ValueError):
        s.delete_paths(items.where("group_id = 1").select("path"))
    for name in ("r.json", "r.txt", "r.html"):
        s.export(str(tmp_path / name), "all")
        assert (tmp_path / name).stat().st_size
    s.delete_paths(spark.createDataFrame([("a",)], "path string"))
    assert s.info()["groups"] == 1
    s.clear()
    assert sum(s.info().values()) == 0


def test_a_rescan_reuses_features(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size_bytes long, mtime_ns long")
    assert {r.path: r.change for r in s.rescan(first).collect()} == {"a": "added", "b": "added", "c": "added"}
    s.save_features("images", spark.createDataFrame([(p, 1, 1, "PNG", 7) for p in "abc"], "path string, width long, height long, format_name string, phash long"))
    s.save_hashes(full=spark.createDataFrame([("a", 1, "fa"), ("b", 2, "fb")], "path string, size_bytes long, digest string"))
    s.save_hashes(sampled=spark.createDataFrame([("a", 1, "sa"), ("c", 3, "sc")], "path string, size_bytes long, digest string"))
    assert {r.path: r.algorithm for r in s.read("hashes").collect()} == {"a": "sha256", "b": "sha256", "c": "sha256-sampled"}
    now = spark.createDataFrame([("a", 1, 1), ("b", 9, 2)], "path string, size_bytes long, mtime_ns long")
    assert {r.path: r.status for r in s.rescan(now).collect()} == {"a": "active", "b": "active", "c": "missing"}
    assert [r.path for r in s.load_features("images").collect()] == ["a"]
    assert [tuple(r) for r in s.load_features("hashes").collect()] == [("a", "fa", "sa")]
    assert sorted(r.path for r in s.read("images").collect()) == ["a", "c"]


def test_runs_errors_and_deletions_are_logged(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.latest_run() is None
    assert (s.start_run(["/x"]), s.start_run(["/y"])) == (1, 2)
    s.finish_run(2, 10, 1)
    s.record_errors(2, spark.createDataFrame([("p", "read", "", "no"), ("q", "read", "aux", "hm")], "path string, stage string, kind string, message string"))
    s.record_errors(1, spark.createDataFrame([("z", "read", None, "old")], "path string, stage string, kind string, message string"))
    assert [tuple(r) for r in s.load_errors(2).collect()] == [("p", "read", "skipped", "no"), ("q", "read", "aux", "hm")]
    assert [r.path for r in s.load_errors().collect()] == ["p", "q", "z"] and s.latest_run() == 2
    assert s.read("runs").where("finished_at IS NOT NULL").first().files_seen == 10
    s.replace(spark.createDataFrame([(1, "exact", 1.0, 1, "k")], GROUPS), spark.createDataFrame([(1, k, f"f{k}", "x", 1.0, 0.5, 5, "text") for k in (1, 2, 3)], ITEMS))
    assert [r.path for r in s.deletable(spark.createDataFrame([(1,)], "group_id long")).orderBy("path").collect()] == ["f2", "f3"]
    outcome = spark.createDataFrame([("f2", True, None), ("f3", False, "in use")], "path string, ok boolean, message string")
    assert s.deleted(outcome, spark.createDataFrame([("f1",), ("f3",)], "path string"), "trash") == [1]
    assert s.read("groups").first().status == "processed" and s.read("deletions").count() == 2
    path = s.export(str(tmp_path), "json", "all", {"files_seen": 10})
    told = json.load(open(path))
    assert path.startswith(f"{tmp_path}/report-") and len(told["groups"][0]["items"]) == 3 and len(told["errors"]) == 2 and told["scan"]["files_seen"] == 10

"""Libraries on disk: what counts as a file of theirs, and what reading them costs."""

from pathlib import Path

from storylake.sources import library


def written(base, files):
    for name, content in files.items():
        at = Path(base) / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)


def test_odd_files_of_a_library(spark, tmp_path):
    one = '[{"index": 0, "title": "é"}, {"title": "b", "index": 1}]'
    written(tmp_path, {
        "s/a+b %41 é/chapters_index.json": one, "s/object/chapters_index.json": '{"index": 5, "title": null, "more": 1}', "s/none/chapters_index.json": "[]", "s/blank/chapters_index.json": "", "s/broken/chapters_index.json": "{no",
        "t/object/metadata.json": '{"story_title": "T"}', "s/.hidden/chapters_index.json": one, "_staged-1/s/chapters_index.json": one, "s/object/other.json": one,
    })
    opened = library.open_library(spark, str(tmp_path))
    assert sorted(map(tuple, opened.index().collect()), key=str) == [("s", "a+b %41 é", 0, "é"), ("s", "a+b %41 é", 1, "b"), ("s", "broken", None, None), ("s", "object", 5, None)]
    assert opened.metadata().collect() == [("t", "object", "T")]
    assert ("s", "object", True, False) in opened.stories().collect() and ("t", "object", False, True) in opened.stories().collect()
    library.copied(spark, str(tmp_path), str(tmp_path / "copy"))
    assert sorted(str(p.relative_to(tmp_path / "copy")) for p in (tmp_path / "copy").rglob("*.json")) == sorted(["s/a+b %41 é/chapters_index.json", "s/blank/chapters_index.json", "s/broken/chapters_index.json", "s/none/chapters_index.json", "s/object/chapters_index.json", "s/object/other.json", "t/object/metadata.json"])


def test_tasks_do_not_grow_with_folders(spark, tmp_path):
    tracker, tasks = spark.sparkContext.statusTracker(), {}
    for n in (10, 200):
        written(tmp_path / str(n), {f"s{i % 2}/c{i}/chapters_index.json": '[{"index": 0, "title": "x"}]' for i in range(n)})
        spark.sparkContext.setJobGroup(f"folders-{n}", "")
        opened = library.open_library(spark, str(tmp_path / str(n)))
        assert opened.resolved(opened.index()).count() == n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(f"folders-{n}") for s in tracker.getJobInfo(job).stageIds]
        tasks[n] = sum(s.numCompletedTasks for s in stages if s)
    assert tasks[200] < tasks[10] + 50

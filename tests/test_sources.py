"""Report listing, chunk files, summaries and failure dedup."""

from testlog.operators.failures import dedup_failures
from testlog.operators.lines import chunks_to_lines
from testlog.sources.chunks import read_log_files
from testlog.sources.reports import list_reports


def test_recursive_globs_and_repeated_inputs(spark, tmp_path):
    for name in ("TEST-a.xml", "x/TEST-b.xml", "x/y/TEST-c.xml", "x/y/other.xml", "x/y/TEST-d.txt"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("<testsuite/>")
    root = str(tmp_path)

    def names(**inputs):
        return sorted(r.path.rpartition("/")[2] for r in list_reports(spark, run_id=1, **inputs).collect())

    assert names(globs=[f"{root}/**/TEST-*.xml"]) == ["TEST-a.xml", "TEST-b.xml", "TEST-c.xml"]
    assert names(globs=[f"{root}/x/**/TEST-*.xml"]) == ["TEST-b.xml", "TEST-c.xml"]
    assert names(globs=[f"{root}/*/TEST-*.xml"]) == ["TEST-b.xml"]
    assert names(dirs=[root], files=[f"{root}/TEST-a.xml"]) == ["TEST-a.xml", "TEST-b.xml", "TEST-c.xml", "other.xml"]


def test_only_so_many_keys_are_remembered(spark):
    rows = []
    for run, keys in ((1, 4096), (2, 4200)):
        labels = [f"t{k}" for k in range(keys)] + ["t0", "t4095", f"t{keys - 1}"]
        rows += [(run, 0, "", i, 0, "TAP", label, None, None, label) for i, label in enumerate(labels, 1)]
    schema = (
        "run_id int, stage int, path string, line_no int, item_no int, source string, label string, suite string, "
        "test_file string, reason string"
    )
    kept = dedup_failures(spark.createDataFrame(rows, schema)).groupBy("run_id").count()
    # run 2: the repeat of its last key passes, since that key came too late to be remembered
    assert dict(kept.collect()) == {1: 4096, 2: 4201}


def test_log_files_in_small_splits(spark, tmp_path):
    texts = {"a": "".join(f"line {i}\n" for i in range(2000)), "b": "\n" * 9000 + "end", "c": "x" * 9000 + "\ny\n", "d": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_text(text)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "4096")
    try:
        chunks = read_log_files(spark, str(tmp_path)).collect()
        lines = chunks_to_lines(read_log_files(spark, str(tmp_path))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        places = sorted((r.seq, r.chunk) for r in chunks if r.run_id == name)
        assert len({seq for seq, _ in places}) == len(places)
        assert "".join(c for _, c in places) == (text if text.endswith("\n") or not text else text + "\n")
        got = [line for _, line in sorted((r.line_no, r.line) for r in lines if r.run_id == name)]
        assert got == text.splitlines()

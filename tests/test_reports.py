"""Run folders: configurations, provenance, merging with its sink, reports."""

import pytest

from marlstone.sources import reports, tables

ROW = "problem_id string, method string, seq long, error string, correct boolean, protocol_hash string, compute_tokens long, usd double, source string, level int"


def test_configurations():
    base = {"model": {"name": "${MODEL:-small}", "size": 1}, "eval": {"threads": 4, "n": 10}, "variants": {"big": ["model.size=7", "eval.n=null"]}}
    got = reports.configure(base, {"model": {"size": 2}}, overrides=("eval.new.deep=[1, true]", "model.note=a=b"), environment={})
    assert got["model"] == {"name": "small", "size": 2, "note": "a=b"} and got["eval"] == {"threads": 4, "n": 10, "new": {"deep": [1, True]}} and base["model"]["size"] == 1
    assert reports.configure(base, variant="big", overrides=("model.size=9",), environment={"MODEL": "x"})["model"] == {"name": "x", "size": 9}
    for bad in ({"overrides": ("model",)}, {"overrides": ("model.size.x=1",)}, {"variant": "none"}):
        with pytest.raises(reports.ConfigError):
            reports.configure(base, environment={}, **bad)
    with pytest.raises(reports.ConfigError, match="KEY"):
        reports.configure({"k": ["${KEY}"]}, environment={})
    a, b = {"x": 1, "eval": {"threads": 4}}, {"eval": {"threads": 8}, "x": 1}
    assert reports.config_hash(a) != reports.config_hash(b) and reports.config_hash(a, ("eval.threads",)) == reports.config_hash(b, ("eval.threads", "no.such"))


def run(spark, folder, rows, config=None, commit="c1"):
    tables.append_jsonl(spark.createDataFrame(rows, ROW), f"{folder}/{reports.ROWS}")
    if config:
        reports.record_run(spark, folder, config, commit, ("threads",))


def test_merge_with_provenance_and_summary(spark, tmp_path):
    one, two, three = (str(tmp_path / x) for x in ("one", "two", "three"))
    row = lambda p, m, seq, error=None, correct=True, protocol="h": (p, m, seq, error, correct, protocol, 10, 0.5, "math500", 1)
    run(spark, one, [row("p1", "sc", 1, "down", False), row("p2", "sc", 2, correct=False), row("p1", "cot", 3)], {"threads": 1, "k": 1})
    run(spark, two, [row("p1", "sc", 1), row("p2", "sc", 2, "down", False), row("p2", "cot", 1)], {"threads": 2, "k": 1})
    assert not reports.record_run(spark, two, {"threads": 2, "k": 1}, "c1") and reports.record_run(spark, two, {"threads": 2, "k": 2}, "c2")
    run(spark, three, [row("p3", "cot", 1, protocol="other")])
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="protocols"):
        reports.merge_folders(spark, [one, two, three], out)
    assert not tables.exists(spark, f"{out}/{reports.ROWS}")
    summary = {r.method_id: (r.n, r.n_errors, r.accuracy) for r in reports.merge_folders(spark, [one, two], out, n_boot=20).collect()}
    assert summary == {"sc": (2, 0, 0.5), "cot": (2, 0, 1.0)}
    rows = tables.read_jsonl(spark, f"{out}/{reports.ROWS}", ROW)
    assert {(r.problem_id, r.method, r.seq, r.error) for r in rows.collect()} == {("p1", "sc", 1, None), ("p2", "sc", 2, None), ("p1", "cot", 3, None), ("p2", "cot", 1, None)}
    told = reports.provenance(spark, out).orderBy("seq").collect()
    assert [(r.seq, r.run, r.git_commit) for r in told] == [(1, "one", "c1"), (2, "two", "c1"), (3, "two", "c2")] and told[0].protocol_hash == told[1].protocol_hash != told[2].protocol_hash
    assert sorted(r.method_id for r in tables.read_summary(spark, f"{out}/{reports.SUMMARY}", "method_id string, method string, n long").collect()) == ["cot", "sc"]
    with pytest.raises(ValueError, match="already"):
        reports.merge_folders(spark, [one], out)
    again = str(tmp_path / "again")
    reports.merge_folders(spark, [one, three], again, allow_mixed=True, n_boot=20)
    assert [r.git_commit for r in reports.provenance(spark, again).orderBy("seq").collect()] == ["c1", "unknown"]


def test_report_tables(spark, tmp_path):
    rows = [(f"p{k}", m, k, None, (k + len(m)) % 3 > 0, "h", 10 * len(m), 0.5, "math500", k % 2) for k in range(12) for m in ("sc", "cot", "a|b")]
    folder = str(tmp_path / "report")
    names = reports.write_report(spark.createDataFrame(rows, ROW), folder, more={"errors": lambda r: r.where("error is not null")})
    assert names == ["audit", "by_level", "errors", "main_table", "summary", "top_compute"]
    lines = [r.value for r in spark.read.text(f"{folder}/main_table.md").collect()]
    assert lines[0].startswith("| method_id | n | accuracy |") and [x.split(" | ")[0] for x in lines[2:]] == ["| cot", "| sc", "| a\\|b"]
    assert "pp [" in lines[2] and lines[3].count("|  ") >= 3 and spark.read.parquet(f"{folder}/errors").count() == 0
    text = reports.main_table_text(spark.createDataFrame([("m", 3, None, None, None, 10.0, None, None, None, None, None, None)], "method_id string, n long, accuracy double, lo double, hi double, mean_tokens double, vs string, diff double, diff_lo double, diff_hi double, p_value double, compute_ratio double")).first()
    assert text.accuracy == "n/a% [n/a, n/a]" and text.difference == ""

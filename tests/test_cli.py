"""The command line, and rules that fail while they run."""

import json

from tallyward.__main__ import main
from tallyward.operators import engine, rules
from tallyward.operators.similarity import durable
from tallyward.sources.catalog import parse, tables

TOOL = {"name": "read_page", "description": "Reads one page of the manual by its number.", "inputSchema": {"type": "object", "additionalProperties": False}}


def test_audit_and_diff(spark, tmp_path, capsys):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps({"tools": [TOOL]}))
    before, after, report = (str(tmp_path / x) for x in ("before.json", "after.json", "report.json"))
    assert main(["audit", str(tmp_path / "a"), "--format", "json", "--output", report, "--snapshot", before], spark) == 0
    assert json.loads(open(report).read())
    (tmp_path / "a" / "one.json").write_text(json.dumps({"tools": [TOOL, {"name": "x", "inputSchema": {"type": "object"}}]}))
    assert main(["audit", str(tmp_path / "a"), "--snapshot", after], spark) == 1
    assert main(["audit", str(tmp_path / "a"), "--fail-on", "never"], spark) == 0
    assert main(["diff", before, before], spark) == 0 and main(["diff", before, after, "--format", "json"], spark) == 1
    (tmp_path / "a" / "one.json").write_text('{"tools": [7]}')
    assert main(["audit", str(tmp_path / "a")], spark) == 2
    assert main(["diff", before, report], spark) == 2
    capsys.readouterr()


def test_rule_that_fails_at_run_time(spark):
    files = spark.createDataFrame([("t", "s", json.dumps({"tools": [TOOL, TOOL]}))], "target_id string, server_id string, content string")
    c = engine.prepare(tables(durable(parse(files))), rules.Config())
    bad = rules.Rule("naming/bad", "error", "", lambda c, r: rules._shape(c.tables.tools.where("assert_true(name = 'other') IS NULL"), r))
    found = engine.raw_findings(c, [*rules.RULES, bad])
    got = {r["rule_id"]: r["message"] for r in found.collect()}
    assert "naming/collision" in got and got["safety/unchecked"].startswith("naming/bad did not finish")

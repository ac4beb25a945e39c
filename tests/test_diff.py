"""Strict JSON, snapshots and comparisons, settings, the landing folder, the entry points."""

import json
import random
import subprocess
import sys

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyward.functions import jsontext, schemas
from tallyward.functions.text import trimmed, u16, u16_cut
from tallyward.operators import diff
from tallyward.operators.similarity import similar_names
from tallyward.sinks import reports
from tallyward.sources import settings
from tallyward.sources.catalog import entries


PLACE = dict(scope="tools/list", serverId="s")


def envelope(tools=(), status="complete", scopes=("tools/list",), servers=("s",), received=None, extra=()):
    definitions = [{"value": v} | PLACE for v in tools]
    n = len(definitions) if received is None else received
    cover = [PLACE | {"scope": x, "pages": 1, "status": status} | dict.fromkeys(("received", "retained"), n if x == PLACE["scope"] else 0) for x in scopes]
    head = {"createdAt": "2024-01-01T00:00:00Z", "format": diff.FORMAT, "schemaVersion": 1}
    return json.dumps(head | {"definitions": definitions, "collection": cover + list(extra), "servers": [{"id": s} for s in servers]})


def compare(spark, a, b):
    return diff.compare(diff.from_text(spark, a), diff.from_text(spark, b))


def counts(c):
    return {k: v for k, v in c.summary.first().asDict().items() if v}


A, B = {"name": "a", "x": {"p": 1, "q": [1, 2]}}, {"name": "b"}


def test_order_is_no_change(spark):
    c = compare(spark, envelope([A, B]), envelope([B, {"x": {"q": [1, 2], "p": 1.0}, "name": "a"}]))
    assert counts(c) == dict(unchanged=3, complete=True) and c.exit_code == 0


def test_changes(spark):
    c = compare(spark, envelope([A, B]), envelope([{"name": "a", "x": {"p": None, "q": [2, 1]}}, {"name": "c"}]))
    assert counts(c) == dict(added=1, removed=1, changed=1, unchanged=1, complete=True) and c.exit_code == 1
    got = {(r["identity"], r["pointer"]): (r["before"], r["after"]) for r in c.fields.collect()}
    assert got[("a", "/x/p")] == ("1", "null") and got[("a", "/x/q")] == ("[1,2]", "[2,1]") and got[("c", "")][0] is None
    assert "absent" in reports.comparison_text(c) and json.loads(reports.comparison_json(c))["summary"]["added"] == 1 and "<table>" in reports.comparison_html(c)


def test_gaps_are_no_removals(spark):
    c = compare(spark, envelope([A, B]), envelope([A], status="incomplete"))
    assert counts(c) == dict(unchanged=2, unpaired=1) and c.exit_code == 2
    file = [PLACE | {"scope": "connection", "pages": 0, "status": "incomplete"} | dict.fromkeys(("received", "retained"), 0)]
    c = compare(spark, envelope([A, B]), envelope([A], extra=file))
    assert counts(c) == dict(unchanged=1, unpaired=2) and c.exit_code == 2


def test_duplicates_and_nameless(spark):
    c = compare(spark, envelope([A, A]), envelope([A, {"title": "x"}]))
    assert counts(c) == dict(unchanged=1, unpaired=4) and c.issues.count() == 2


def test_problems(spark):
    assert diff.problems(diff.from_text(spark, envelope([A]))).count() == 0
    for bad in (envelope([A], received=3), envelope([A], scopes=("tools/list", "tools/list")), envelope([A], servers=("s", "t")), envelope([A], scopes=("prompts/list",)), envelope([A], status="unsupported"), envelope([A], status="odd")):
        assert diff.problems(diff.from_text(spark, bad)).count() > 0, bad
    for broken in ('{"format": 1}', "[]", envelope([A]).replace("2024-01-01T00:00:00Z", "never"), envelope([A])[:-1] + ', "more": 1}'):
        with pytest.raises(jsontext.JsonRefused):
            diff.from_text(spark, broken)


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a":1,"\\u0061":2}', "1e400", "1e-999", "9007199254740993", "[" * 129 + "]" * 129, "NaN", "{'a':1}", "[1,]", "0.1000000000000000055511151231257827021181583404541015625"])
def test_refused(text):
    with pytest.raises(jsontext.JsonRefused):
        jsontext.read(text)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), x, max_size=4), max_leaves=12)


@given(json_values)
def test_canonical_round_trip(x):
    text = jsontext.canonical(x)
    assert jsontext.canonical(jsontext.read(text)) == text and jsontext.changed_fields(x, jsontext.read(text)) == []


@given(st.text(), st.integers(0, 30))
def test_utf16(text, n):
    raw = text.encode("utf-16-be", "surrogatepass")
    assert u16(text) == len(raw) // 2 and u16(u16_cut(text, n)) <= n and text.startswith(u16_cut(text, n))
    assert trimmed(f"\t \u3000{trimmed(text)}\ufeff\n") == trimmed(text)


def test_decode():
    assert jsontext.decode(b"\xef\xbb\xbf{}") == "{}" and jsontext.decode(b"\xff\xfe{\0}\0") == "{}"
    for bad in (b"\xff", b"\xc3("):
        with pytest.raises(jsontext.JsonRefused):
            jsontext.decode(bad)


def test_settings():
    c = settings.settings('{"budget": 10, "severities": {"naming/generic": "off"}, "ignore": ["a"]}')
    assert c.budget == 10 and c.ignore == ["a"] and json.loads(settings.as_text(c))["totalBudget"] == 16000
    for bad in ('{"budget": 0}', '{"budget": true}', '{"x": 1}', '{"severities": {"a": "fatal"}}', '{"ignore": [1]}'):
        with pytest.raises(jsontext.JsonRefused):
            settings.settings(bad)
    assert len(settings.known_rules()) == 27


def test_client_configuration():
    text = '{ // servers\n "mcpServers": {"a": {"command": "x", "args": ["${env:HOME_DIR}", "${A:-d}", "${userHome}/y"]}, "b": {"url": "${input:q}"}, "c": {"disabled": true}, "d": 3, "e": {"url": "http://x/", "envFile": "${workspaceFolder}/.env", "headers": {"k": "${TOKEN}"}}, },}'
    ready, gaps = settings.servers(text, {"HOME_DIR": "/h"}, "/w", "/u", {"/w/.env": "export TOKEN='t'  # secret\nTOKEN=\"u\\n\"\n"})
    assert [r["server_id"] for r in ready] == ["a", "e"] and ready[0]["entry"]["args"] == ["/h", "d", "/u/y"] and ready[1]["entry"]["headers"]["k"] == "u\n"
    assert [(g["server_id"], g["status"]) for g in gaps] == [("b", "incomplete"), ("c", "disabled"), ("d", "incomplete")]


def test_similar_names(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abC_") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"a" * 40, "a" * 39 + "b"})
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]
    want = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d, n = distance(a.lower(), b.lower()), max(len(a), len(b))
            if n >= 5 and 1 <= d <= 2 and 10 * d <= 3 * n:
                want.add((a, b, d))
    got = similar_names(spark.createDataFrame([(1, n) for n in names], "g int, name string"), ["g"])
    assert {(r["a"], r["b"], r["distance"]) for r in got.collect()} == want and len(want) > 20


@pytest.mark.parametrize(("schema", "status"), [({"type": "object"}, "valid"), ({"properties": {"a": {"minimum": "1"}}}, "invalid"), ({"$ref": "https://elsewhere.example/x"}, "unchecked"), ({"$schema": "http://json-schema.org/draft-04/schema#"}, "unchecked"), ({"$schema": 3}, "invalid"), ({"$defs": {"a": {"$anchor": "k"}}, "$ref": "#k"}, "valid"), ({"$id": "https://a.example/r", "$defs": {"b": {"$id": "b"}}, "$ref": "b"}, "valid"), ({"required": ["a", "a"]}, "invalid"), ({"enum": [{"type": 3}]}, "valid"), ({"allOf": []}, "invalid"), ({"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "string"}]}, "valid"), ({"items": [{"type": "string"}]}, "invalid")])
def test_schema_check(schema, status):
    assert schemas.check(schema)[0] == status


def test_junk_never_stops_a_scan():
    rng = random.Random(7)
    junk = [None, 0, -1, 1e308, "", [], {}, {"type": 3}, {"properties": []}, {"enum": "x"}, True]
    for _ in range(300):
        tool = {k: rng.choice(junk) for k in ("name", "title", "description", "inputSchema", "outputSchema", "annotations") if rng.random() < 0.7}
        rows = list(entries(json.dumps({"tools": [tool, rng.choice(junk)], "prompts": [{"name": "p", "arguments": rng.choice(junk)}], "resources": rng.choice(junk)}), "t", "s"))
        assert rows[0]["what"] == "server" and rows[-1]["scope"] == "file"


def test_files(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    reports.write_report(a, "1")
    reports.write_report(a, "2")
    assert open(a).read() == "2"
    reports.write_snapshot(b, "x")
    with pytest.raises(FileExistsError):
        reports.write_snapshot(b, "y")
    with pytest.raises(ValueError):
        reports.check_paths([a], [a])
    with pytest.raises(ValueError):
        reports.check_paths([], [], b)
    reports.check_paths([a], [b])


def test_landing_folder(spark, tmp_path):
    from tallyward.streaming import landing

    into, out = tmp_path / "in", tmp_path / "out"
    into.mkdir()
    for k, text in enumerate(['{"tools": [{"name": "run"}]}', "{"]):
        (into / f"{k}.json").write_text(text)
        landing.start(spark, str(into), str(out), once=True).awaitTermination()
    found = spark.read.parquet(str(out / "findings"))
    assert {r["rule_id"] for r in found.collect()} >= {"description/missing", "naming/generic", "collection/incomplete"} and spark.read.parquet(str(out / "summary")).count() == 2


def test_entry_without_the_subpackage(tmp_path):
    """The other queries work where the subpackage and the pipeline are gone."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tallyward", tmp_path / "tallyward", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'collision' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


ENV_LINES = [
    ("TOKEN=some-token\n", "some-token"),
    ("TOKEN=some-token # an account\n", "some-token"),
    ('TOKEN="some-token" # an account\n', "some-token"),
    ("TOKEN='some-token' # an account\n", "some-token"),
    ('TOKEN="some#token" # a quoted hash stays\n', "some#token"),
    ("TOKEN=some-token#comment\n", "some-token"),
    ('TOKEN="line1\\nline2\\rline3"\n', "line1\nline2\rline3"),
    ("TOKEN='line1\\nline2'\n", "line1\\nline2"),
    ("TOKEN=`some#token` # an account\n", "some#token"),
    ("TOKEN: some-token\n", "some-token"),
    ("TOKEN:some-token\n", "some-token"),
    ("TOKEN=some-token\rNOTE=second\r", "some-token"),
    ("export TOKEN=some-token # exported\n", "some-token"),
    ("TOKEN='${KEEP}'\n", "${KEEP}"),
    ("TOKEN=old\nTOKEN=new\n", "new"),
    ('TOKEN="" # empty on purpose\n', ""),
    ("\ufeffTOKEN=some-token\r\n", "some-token"),
    ('TOKEN="some\\"#token" # outside\n', 'some\\"#token'),
    ('TOKEN="scheme:value=one#two"\n', "scheme:value=one#two"),
    ("TOKEN='open\nNOTE=x' # y\n", "'open"),
    ("# TOKEN=x\n=y\nno separator\n", None),
]


@pytest.mark.parametrize(("text", "value"), ENV_LINES)
def test_env_file(text, value):
    assert jsontext.env_file(text).get("TOKEN") == value

"""Reports: JSON, SARIF, Markdown, terminal and HTML. They render one audit's small tables on the driver.

Text that servers wrote never reaches a report raw: it is escaped for its format, and
control characters are written out.
"""

from __future__ import annotations

import html
import json
import os
import tempfile
from collections import defaultdict
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hidden import visible
from ..functions.text import html_safe, markdown_safe
from ..operators.engine import Audit, top_offenders
from ..operators.rules import RULES

_RANK = {s: i for i, s in enumerate("error warning info".split())}
_ICON = {"error": "✖", "warning": "▲", "info": "•"}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def _findings(a: Audit) -> list[dict]:
    return _rows(a.findings.orderBy("target_id", "rule_ord", "server_id", "item_ord", "subject_name", "field", "message"))


def as_json(a: Audit, generated_at: str, vocabulary: str | None = None) -> str:
    body = {"generatedAt": generated_at, "tokenizer": vocabulary, "servers": _rows(a.tables.servers), "collection": _rows(a.tables.collection), "summary": _rows(a.summary), "findings": _findings(a)}
    return json.dumps(body, ensure_ascii=False, indent=2)


def _uri(f: dict) -> str:
    safe = "!'()*~"
    return "mcp://" + "/".join(quote(str(f[k] or "").encode("utf-8", "replace"), safe=safe) for k in ("server_id", "subject_kind", "subject_name"))


def as_sarif(a: Audit, version: str = "1") -> str:
    """SARIF 2.1.0: only rules that found something, and whether the audit is complete."""
    found = _findings(a)
    used = {f["rule_id"] for f in found}
    rules = [{"id": r.id, "name": r.slug, "shortDescription": {"text": r.summary}, "defaultConfiguration": {"level": _level(r.severity)}} for r in RULES if r.id in used]
    results = [{"ruleId": f["rule_id"], "level": _level(f["severity"]), "message": {"text": f["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": _uri(f)}}, "logicalLocations": [{"name": f["subject_name"], "kind": f["subject_kind"]}]}]} for f in found]
    complete = all(r["complete"] for r in a.summary.select("complete").collect())
    run = {"tool": {"driver": {"name": "tallyward", "version": version, "rules": rules}}, "results": results, "invocations": [{"executionSuccessful": complete}]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, ensure_ascii=False)


def _level(severity: str) -> str:
    return "note" if severity == "info" else severity


def _grouped(found: list[dict]) -> list[tuple[tuple, list[dict]]]:
    groups = defaultdict(list)
    for f in found:
        groups[f["server_id"] or "", f["subject_kind"] or "", f["subject_name"] or ""].append(f)
    return sorted(groups.items())


def status_text(s: dict) -> str:
    if not s["complete"]:
        return "incomplete: some of the catalog was not read or not checked"
    return "errors" if s["errors"] else "warnings" if s["warnings"] else "nothing to report"


def as_markdown(a: Audit) -> str:
    out = ["# Catalog audit", ""]
    for s in _rows(a.summary.orderBy("target_id")):
        score = "not scored" if s["score"] is None else f"{s['score']} of 100"
        out += [f"**{markdown_safe(visible(s['target_id']))}**: {score}; {s['errors']} errors, {s['warnings']} warnings, {s['infos']} notes ({status_text(s)}).", ""]
    heads = "Severity Rule Subject Finding".split()
    out += ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)]
    for f in sorted(_findings(a), key=lambda f: _RANK[f["severity"]]):
        cells = [f["severity"], f["rule_id"], f"{f['subject_kind']} {f['subject_name']}", f["message"]]
        out.append("| " + " | ".join(markdown_safe(visible(c).replace("\n", " ").replace("\r", " ")) for c in cells) + " |")
    return "\n".join(out) + "\n"


def as_terminal(a: Audit, width: int = 100) -> str:
    import textwrap

    out = []
    for (server, kind, name), found in _grouped(_findings(a)):
        worst = min(found, key=lambda f: _RANK[f["severity"]])["severity"]
        out.append(visible(f"{_ICON[worst]} {kind} {name} ({server})").replace("\n", "\\n"))
        for f in found:
            out += textwrap.wrap(visible(f"{f['severity']} {f['rule_id']}: {f['message']}".replace("\n", "\\n")), width, initial_indent="    ", subsequent_indent="      ")
    if a.tokens is not None:
        out += ["", "Most tokens:"] + [f"    {visible(t['name'])}: {t['tokens']}" for t in _rows(top_offenders(a.tokens))]
    for s in _rows(a.summary.orderBy("target_id")):
        out.append(f"{visible(s['target_id'])}: {s['errors']} errors, {s['warnings']} warnings, {s['infos']} notes; score {'-' if s['score'] is None else s['score']}; {status_text(s)}")
    return "\n".join(out) + "\n"


def as_html(a: Audit) -> str:
    """One self-contained page without scripts; the worst subjects first, and a bar for each of the largest tools."""
    safe = lambda x: html_safe(visible(str(x)))
    cards = []
    for (server, kind, name), found in sorted(_grouped(_findings(a)), key=lambda g: (min(_RANK[f["severity"]] for f in g[1]), g[0])):
        items = "".join(f"<li class={f['severity']}>{safe(f['rule_id'])}: {safe(f['message'])}</li>" for f in found)
        cards.append(f"<section><h2>{safe(kind)} {safe(name)}</h2><p>{safe(server)}</p><ul>{items}</ul></section>")
    bars = ""
    if a.tokens is not None:
        top = [t for t in _rows(top_offenders(a.tokens, 8)) if t["tokens"] > 0]
        bars = "".join(f"<p>{safe(t['name'])} <meter max={top[0]['tokens']} value={t['tokens']}></meter> {t['tokens']}</p>" for t in top)
    sums = "".join(f"<p>{safe(s['target_id'])}: {safe(status_text(s))}, score {'-' if s['score'] is None else s['score']}</p>" for s in _rows(a.summary.orderBy("target_id")))
    policy = "default-src 'none'; style-src 'unsafe-inline'"
    return f'<!doctype html><meta charset=utf-8><meta http-equiv=Content-Security-Policy content="{html.escape(policy)}"><title>Catalog audit</title><style>.error{{color:#a00}}.warning{{color:#850}}</style><h1>Catalog audit</h1>{sums}{bars}{"".join(cards)}\n'


def comparison_text(c, preview: int = 320) -> str:
    """A comparison for the terminal, long values cut."""
    cut = lambda x: "absent" if x is None else visible(x if len(x) <= preview else x[:preview] + "...")
    s = c.summary.first().asDict()
    out = [f"{s['added']} added, {s['removed']} removed, {s['changed']} changed, {s['unchanged']} unchanged, {s['unpaired']} unpaired"]
    for f in _rows(c.fields.orderBy("server_id", "scope", "identity", "pointer")):
        out.append(visible(f"{f['server_id']} {f['scope']} {f['identity']} {f['pointer'] or '/'}: ") + f"{cut(f['before'])} -> {cut(f['after'])}")
    out += [visible(f"! {i['server_id']} {i['scope']}: {i['issue']}") for i in _rows(c.issues.orderBy("server_id", "scope", "issue"))]
    return "\n".join(out) + "\n"


def comparison_json(c) -> str:
    return json.dumps({"summary": c.summary.first().asDict(), "changes": _rows(c.changes), "fields": _rows(c.fields), "issues": _rows(c.issues)}, ensure_ascii=False)


def comparison_html(c, preview: int = 6000) -> str:
    rows = "".join(f"<tr><td>{html_safe(visible(' '.join(x.strip().split(chr(10)))))}</td></tr>" for x in comparison_text(c, preview).splitlines())
    return f"<!doctype html><meta charset=utf-8><title>Comparison</title><table>{rows}</table>\n"


def check_paths(outputs: list[str], inputs: list[str], snapshot: str | None = None) -> None:
    """No output may be an input, by path or by file, nor a link; a snapshot must not exist yet."""
    for o in [*outputs, *([snapshot] if snapshot else [])]:
        if os.path.islink(o):
            raise ValueError(f"{o} is a link")
        for i in [*inputs, *(x for x in [*outputs, snapshot] if x and x is not o)]:
            if os.path.realpath(o) == os.path.realpath(i) or (os.path.exists(o) and os.path.exists(i) and os.path.samefile(o, i)):
                raise ValueError(f"{o} and {i} are the same file")
    if snapshot and os.path.exists(snapshot):
        raise ValueError(f"{snapshot} exists")


def write_report(path: str, text: str) -> None:
    """Replace a file in one step; readable by its owner only."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", errors="replace") as f:
            f.write(text)
        os.chmod(temporary, 0o600)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_snapshot(path: str, text: str) -> None:
    """Create a file that must not exist; nothing is left of a failure."""
    with open(path, "x", encoding="utf-8") as f:
        try:
            f.write(text)
        except BaseException:
            os.unlink(path)
            raise


def write_census(rows: DataFrame, path: str) -> None:
    """JSON lines, one row for each target, written by the executors."""
    rows.withColumn("_at", F.lit(1)).drop("_at").write.mode("overwrite").json(path)


def exit_code(failed: bool, usage_error: bool = False) -> int:
    return 2 if usage_error else int(failed)

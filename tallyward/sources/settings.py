"""Client configurations and audit settings: what would be launched, and with which limits."""

from __future__ import annotations

import json
from typing import Any

from ..functions.jsontext import JsonRefused, env_file, fill, read, strip_comments
from ..operators.rules import RULES, Config
from .catalog import gap

SEVERITIES = ("error", "warning", "info", "off")


def servers(text: str, env: dict[str, str] | None = None, folder: str = ".", home: str = "~", files: dict[str, str] | None = None) -> tuple[list[dict], list[dict]]:
    """(launchable entries, coverage rows for the others) of a client configuration with comments.

    ``files``: texts of env files, by path. Entries are only described; nothing is launched.
    """
    value = read(strip_comments(text))
    if not isinstance(value, dict):
        raise JsonRefused("a configuration is an object")
    nested = value.get("mcp")
    found = next((v for v in (value.get("mcpServers"), value.get("servers"), nested.get("servers") if isinstance(nested, dict) else None) if isinstance(v, dict)), None)
    if found is None:
        raise JsonRefused("no servers in this configuration")
    ready, gaps = [], []
    for name, entry in found.items():
        lost = lambda status, detail, name=name: gaps.append({"server_id": name, "scope": "config"} | gap(status, detail))
        if not isinstance(entry, dict):
            lost("incomplete", "The entry is no object.")
        elif entry.get("disabled") is True or entry.get("enabled") is False:
            lost("disabled", "Disabled in the configuration.")
        else:
            mine = dict(env or {})
            if isinstance(entry.get("envFile"), str):
                path = fill(entry["envFile"], mine, folder, home)
                mine |= env_file((files or {}).get(path or "", ""))
            filled = _filled(entry, mine, folder, home)
            if filled is None:
                lost("incomplete", "A placeholder is not resolved.")
            elif isinstance(filled.get("command"), str) or isinstance(filled.get("url"), str):
                ready.append({"server_id": name, "kind": "command" if "command" in filled else "url", "entry": filled})
            else:
                lost("incomplete", "Neither a command nor a URL.")
    return ready, gaps


def _filled(x: Any, env: dict[str, str], folder: str, home: str) -> Any:
    if isinstance(x, str):
        return fill(x, env, folder, home)
    if isinstance(x, list):
        out = [_filled(i, env, folder, home) for i in x]
        return None if any(o is None and i is not None for o, i in zip(out, x, strict=True)) else out
    if isinstance(x, dict):
        out = {k: _filled(v, env, folder, home) for k, v in x.items()}
        return None if any(out[k] is None and x[k] is not None for k in x) else out
    return x


def settings(text: str, vocabulary: str | None = None, pattern: str | None = None) -> Config:
    """Audit settings; unknown keys and wrong types are refused."""
    v = read(text)
    if not isinstance(v, dict) or set(v) - {"budget", "totalBudget", "severities", "ignore"}:
        raise JsonRefused("unknown settings")
    for k in ("budget", "totalBudget"):
        if k in v and (isinstance(v[k], bool) or not isinstance(v[k], int) or not 0 < v[k] <= 2**53 - 1):
            raise JsonRefused(f"{k} is a whole number above zero")
    over = v.get("severities", {})
    if not isinstance(over, dict) or any(x not in SEVERITIES for x in over.values()):
        raise JsonRefused("severities are error, warning, info or off")
    ignore = v.get("ignore", [])
    if not isinstance(ignore, list) or not all(isinstance(x, str) for x in ignore):
        raise JsonRefused("ignore is a list of strings")
    return Config(v.get("budget", 400), v.get("totalBudget", 16_000), over, ignore, vocabulary, pattern)


def known_rules() -> list[str]:
    return [r.id for r in RULES]


def as_text(c: Config) -> str:
    return json.dumps({"budget": c.budget, "totalBudget": c.total_budget, "severities": c.severities, "ignore": c.ignore})

"""Text helpers that keep the counting and matching rules of catalog JSON (UTF-16 units, wide white space)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the catalogs' own tools see it: wider than ASCII.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Any character that ends no line.
ANY = "[^\n\r\u2028\u2029]"
_TRIM = re.compile(f"^[{SPACE}]+|[{SPACE}]+\\Z")


def u16(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "\uffff" for c in text)


def u16_cut(text: str, most: int) -> str:
    """The first ``most`` UTF-16 units; half of a pair is left out."""
    if u16(text) <= most:
        return text
    out, used = [], 0
    for c in text:
        used += 2 if c > "\uffff" else 1
        if used > most:
            break
        out.append(c)
    return "".join(out)


def trimmed(text: str) -> str:
    return _TRIM.sub("", text)


def wide(pattern: str, flags: int = re.IGNORECASE) -> re.Pattern:
    """Compile with ``\\s`` as SPACE and an unescaped ``@`` for ANY; classes stay ASCII."""
    return re.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("@", ANY), flags | re.ASCII)


# ------------------------------------------------------------------ columns


def u16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def trim_wide(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def is_blank(c: Column) -> Column:
    """Absent, or white space only."""
    return c.isNull() | (trim_wide(c) == "")


def word_count(c: Column) -> Column:
    """Words between white space of a trimmed text."""
    return F.size(F.split(c, f"[{SPACE}]+"))


def word_set(c: Column) -> Column:
    """Distinct words of more than two characters, as near-duplicate rules compare them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def slug(rule_id: str) -> str:
    return rule_id.replace("/", "-", 1)


def pointer_part(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def markdown_safe(text: str) -> str:
    """ASCII punctuation of untrusted text as character references."""
    return re.sub(r"[!-/:-@\[-`{-~]", lambda m: f"&#{ord(m[0])};", text)


def html_safe(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")

"""Token estimates: a pluggable encoder over a public rank file. The vocabulary's name travels with the figures."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import JsonRefused, compact, read

#: Runs of one class (white space, or none) longer than this are cut.
RUN = 2048
_LONG = re.compile(r"\s{%d,}|\S{%d,}" % (RUN + 1, RUN + 1))
_loaded: dict[str, Callable[[str], int]] = {}


def vocabulary(path: str) -> str:
    """The name that goes with estimates."""
    return os.path.basename(path).split(".")[0]


def counter(path: str, pattern: str) -> Callable[[str], int]:
    """Counts the tokens of a text; loaded once for each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(vocabulary(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def count(text: str) -> int:
            total, at = 0, 0
            for m in _LONG.finditer(text):
                total += len(encoding.encode_ordinary(text[at : m.start()]))
                total += sum(len(encoding.encode_ordinary(m[0][i : i + RUN])) for i in range(0, len(m[0]), RUN))
                at = m.end()
            return total + len(encoding.encode_ordinary(text[at:]))

        _loaded[path] = count
    return _loaded[path]


def tool_text(name: str, description: str | None, input_schema: str | None) -> str | None:
    """What a client sends for a tool: name, description and input schema as compact JSON; None where that fails."""
    try:
        parts: dict = {"name": name}
        if description is not None:
            parts["description"] = description
        if input_schema is not None:
            parts["inputSchema"] = read(input_schema)
        return compact(parts)
    except JsonRefused:
        return None


def tool_tokens(name: Column, description: Column, input_schema: Column, path: str, pattern: str) -> Column:
    """Estimated tokens of a tool; null where it cannot be counted."""

    @F.pandas_udf("long")
    def estimate(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        count = counter(path, pattern)
        for n, d, s in batches:
            texts = (tool_text(*(None if pd.isna(x) else x for x in row)) for row in zip(n, d, s, strict=True))
            yield pd.Series([None if t is None else count(t) for t in texts], dtype="Int64")

    return estimate(name, description, input_schema)

"""Globs compiled to anchored regular expressions (P1), safe paths and globs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SAFE_SEGMENT = re.compile(r"^(?!\.{1,2}$)[^\\\x00]+$")


def _alternatives(glob: str) -> list[str]:
    """Brace alternatives, innermost last."""
    depth, start = 0, None
    for i, c in enumerate(glob):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                inner, parts, level, last = glob[start + 1 : i], [], 0, 0
                for j, d in enumerate(inner):
                    level += (d == "{") - (d == "}")
                    if d == "," and level == 0:
                        parts.append(inner[last:j])
                        last = j + 1
                parts.append(inner[last:])
                if len(parts) == 1:
                    continue
                return [x for p in parts for x in _alternatives(glob[:start] + p + glob[i + 1 :])]
    return [glob]


def _segment(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            while part[i : i + 1] == "*":
                i += 1
            out += "[^/]*" if i < len(part) or out else "[^/]+"
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[" and "]" in part[i + 2 :]:
            end = part.index("]", i + 2)
            body = part[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return ("(?!\\.)" if part[:1] in ("*", "?", "[") else "") + out


def regex(glob: str) -> str:
    """``*`` stays within a segment, ``**`` spans segments, a leading dot must be written, ``!`` negates, ``#`` begins a comment."""
    if not glob or glob.startswith("#"):
        return "(?!)"
    if glob.startswith("!"):
        return f"^(?!(?:{regex(glob[1:])[1:-1]})$).*$" if glob[1:] else "(?!)"
    dotless = "(?!\\.)[^/]+"
    found = []
    for option in _alternatives(glob):
        parts, out = option.split("/"), ""
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                out += f"{dotless}(?:/{dotless})*" if last else f"(?:{dotless}/)*"
            else:
                out += _segment(part) + ("" if last else "/")
        found.append(out)
    return "^(?:" + "|".join(found) + ")$"


def matches(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(regex(g)) for g in globs], F.lit(False))


def safe_path(path: Column) -> Column:
    """Relative, without empty, ``.`` or ``..`` segments, backslashes or NUL."""
    return (path != "") & ~path.contains("\\") & ~path.contains("\u0000") & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def is_safe(text: str) -> bool:
    return bool(text) and all(_SAFE_SEGMENT.match(s) for s in text.split("/"))

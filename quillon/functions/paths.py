"""Paths and URLs as text; nothing is cleaned, so a scheme's slashes stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base(p: Column) -> Column:
    """The last element; of an empty path '.', of slashes alone '/'."""
    bare = F.regexp_replace(p, "/+$", "")
    return F.when(p == "", F.lit(".")).when(bare == "", F.lit("/")).otherwise(F.substring_index(bare, "/", -1))


def dirname(p: Column) -> Column:
    """All before the last slash; empty if there is none, '/' at the root."""
    head = F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(~F.contains(p, F.lit("/")), F.lit("")).when(head == "", F.lit("/")).otherwise(head)


def ext(p: Column) -> Column:
    """From the last dot of the last element on; else empty."""
    return F.regexp_extract(p, r"(?s)(\.[^./]*)$", 1)


def join(parts: Column) -> Column:
    """The elements that are not empty, with slashes between."""
    return F.array_join(F.filter(parts, lambda x: x != ""), "/")


def glob_pattern(glob: str) -> str:
    """An anchored Java pattern of a shell glob: * and ? stay within an element, [a-z] and [^a-z] are classes."""
    out, i = ["^"], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError("syntax error in pattern")
            body = glob[i + 1 : end].replace("[", "\\[").replace("&&", "\\&\\&")
            out.append(f"[{body}]")
            i = end
        elif c == "\\":
            if i + 1 == len(glob):
                raise ValueError("syntax error in pattern")
            i += 1
            out.append("\\" + glob[i] if not glob[i].isalnum() else glob[i])
        else:
            out.append("\\" + c if c in ".+(){}^$|" else c)
        i += 1
    return "".join([*out, "\\z"])


def glob_matches(p: Column, glob: str) -> Column:
    return p.rlike(glob_pattern(glob))

"""Regular expressions of the RE2 kind on Spark's Java engine.

``translate`` turns the syntax that differs into Java's and refuses what RE2 does
not have: look-around, back references, atomic groups and possessive repeats.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import check

# POSIX classes inside brackets, and Java's names for them.
_POSIX = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\p{Space}",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}


class BadPattern(ValueError):
    """A pattern that is no RE2 expression."""


def translate(pattern: str) -> str:
    """The Java pattern of an RE2 one."""
    out, i, depth, n = [], 0, 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                raise BadPattern("trailing backslash")
            d = pattern[i + 1]
            if d == "Q":
                end = pattern.find("\\E", i + 2)
                end = n if end < 0 else end
                out.append(re.escape(pattern[i + 2 : end]))
                i = end + 2
                continue
            if d in "123456789" or d == "k":
                raise BadPattern("back references are not supported")
            if d == "z":
                out.append("\\z")
            elif d == "C":
                raise BadPattern("\\C is not supported")
            else:
                out.append(c + d)
            i += 2
            continue
        if depth:
            m = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if m:
                if m[2] not in _POSIX:
                    raise BadPattern(f"unknown class {m[0]}")
                name = _POSIX[m[2]]
                out.append(name if not m[1] else name[0] + name[1].swapcase() + name[2:])
                i += m.end()
                continue
            if c == "]" and pattern[i - 1 : i] != "[" and pattern[i - 2 : i] != "[^":
                depth = 0
            elif c == "[" or c == "&" and pattern[i + 1 : i + 2] == "&":
                c = "\\" + c  # Java reads a nested class or an intersection there
            out.append(c)
            i += 1
            continue
        if c == "[":
            depth = 1
            out.append(c)
            i += 1
            for p in ("^", "]"):
                if pattern[i : i + 1] == p:
                    out.append("\\]" if p == "]" else p)
                    i += 1
            continue
        if pattern.startswith("(?", i):
            m = re.match(r"\(\?P?<(\w+)>", pattern[i:])
            if m:
                out.append(f"(?<{m[1].replace('_', '')}>")
                i += m.end()
                continue
            if re.match(r"\(\?(<?[=!]|>)", pattern[i:]):
                raise BadPattern("look-around and atomic groups are not supported")
        if c == "+" and out and out[-1] in ("*", "+", "?", "}"):
            raise BadPattern("possessive repeats are not supported")
        if c == "$":
            out.append("\\z")  # RE2 has no match before a final line end
            i += 1
            continue
        out.append(c)
        i += 1
    if depth:
        raise BadPattern("missing closing ]")
    return "".join(out)


def group_count(pattern: str) -> int:
    """Capturing groups of a pattern."""
    n, i, inside = 0, 0, False
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        if inside:
            inside = pattern[i] != "]" or pattern[i - 1] in "[^"
        elif pattern[i] == "[":
            inside = True
        elif pattern[i] == "(" and (pattern[i + 1 : i + 2] != "?" or re.match(r"\(\?P?<\w+>", pattern[i:])):
            n += 1
        i += 1
    return n


def matches(s: Column, pattern: str) -> Column:
    """Whether the pattern matches anywhere in s."""
    return s.rlike(translate(pattern))


def groups(s: Column, pattern: str) -> Column:
    """What each capturing group of the first match holds; no match raises."""
    java, n = translate(pattern), group_count(pattern)
    found = F.array(*[F.regexp_extract(s, java, i + 1) for i in range(n)]).cast("array<string>")
    return check(s.rlike(java), found, F.concat(F.lit("regexp does not match: "), s))


def template(replacement: str, n_groups: int) -> str:
    """The Java form of a replacement: $1, ${1} and $$; the longest name counts, and an unknown group is empty."""
    out, i = [], 0
    while i < len(replacement):
        c = replacement[i]
        if c == "$":
            m = re.match(r"\$(?:\{(\w+)\}|(\w+)|(\$))", replacement[i:])
            if not m:
                out.append("\\$")
                i += 1
                continue
            name = m[1] or m[2]
            if m[3]:
                out.append("\\$")
            elif name.isdigit() and int(name) <= n_groups:
                out.append(f"${int(name)}")
                if re.match(r"\d", replacement[i + m.end() :]):
                    out.append("\\")  # so that a digit after it is text
            i += m.end()
            continue
        out.append("\\" + c if c in "\\$" else c)
        i += 1
    return "".join(out)


def replace(s: Column, pattern: str, replacement: str) -> Column:
    """All matches replaced; the replacement may name groups."""
    return F.regexp_replace(s, F.lit(translate(pattern)), F.lit(template(replacement, group_count(pattern))))

"""Name and path patterns turned into Column conditions.

Plain shapes become ``==``, ``startswith``, ``endswith`` or ``contains`` so that
Catalyst can push them to the scan; only the rest become regular expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from arborlake.functions.derive import any_of, fold

_JAVA_SPECIAL = set(r"\.[]{}()*+-?^$|&~#")
_SEPARATORS = r"[^/\\]"


def quote(text: str) -> str:
    """Escape text for a Java regular expression."""
    return "".join(f"\\{ch}" if ch in _JAVA_SPECIAL else ch for ch in text)


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def wildcard_regex(pattern: str, one: str = ".", many: str = ".*") -> str:
    """Unanchored regex of a ``*``/``?`` pattern."""
    parts = {"*": many, "?": one}
    return "".join(parts.get(ch) or quote(ch) for ch in re.sub(r"\*+", "*", pattern))


def class_glob_regex(pattern: str) -> str:
    """Anchored regex of a glob with ``**``, ``[abc]`` and ``[!abc]``.

    ``*`` and ``?`` stay inside one path component; ``**`` crosses components.
    """
    tokens = re.compile(r"\*\*|\*|\?|\[(!?)((?:\\.|[^\]])*)\]|(.)", re.DOTALL)

    def piece(m: re.Match) -> str:
        text = m[0]
        if text == "**":
            return ".*"
        if text in ("*", "?"):
            return _SEPARATORS + ("*" if text == "*" else "")
        if m[3] is not None:
            if text == "[":
                raise ValueError(f"unclosed character class: {pattern!r}")
            return quote(text)
        members = re.sub(r"(?<!\\)([\[&^])", r"\\\1", m[2])
        return f"[{'^' if m[1] else ''}{members}]"

    return f"^{tokens.sub(piece, pattern)}$"


def named(name: Column) -> Column:
    """Rows that carry a searchable name: not empty and not the root's '.'."""
    return (name != "") & (name != ".")


def glob(subject: Column, pattern: str) -> Column:
    """``*``/``?`` pattern over the whole subject, in the cheapest form."""
    pattern = re.sub(r"\*+", "*", pattern)
    if "?" not in pattern:
        pieces = pattern.split("*")
        head, tail = pieces[0], pieces[-1]
        if len(pieces) == 1:
            return subject == pattern
        if pattern == "*":
            return F.lit(True)
        if len(pieces) == 2:
            conditions = [subject.startswith(head)] if head else []
            conditions += [subject.endswith(tail)] if tail else []
            if head and tail:
                conditions.append(F.char_length(subject) >= len(head) + len(tail))
            return _and(conditions)
        if len(pieces) == 3 and not head and not tail:
            return subject.contains(pieces[1])
    return subject.rlike(f"(?s)^{wildcard_regex(pattern)}$")


def _and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def class_glob(subject: Column, pattern: str) -> Column:
    return subject.rlike("(?s)" + class_glob_regex(pattern))


def text_matches(subject: Column, pattern: str, whole: bool = False) -> Column:
    """A pattern or ``|`` alternatives: globs match whole, bare text anywhere."""
    def one(p: str) -> Column:
        if is_glob(p):
            return glob(subject, p)
        return subject == p if whole else subject.contains(p)

    return any_of([one(p) for p in pattern.split("|")]) if "|" in pattern else one(pattern)


def name_matches(name: Column, pattern: str, case_sensitive: bool = False,
                 whole: bool = False) -> Column:
    """Name search: substring, glob, alternatives, or whole name."""
    subject = name if case_sensitive else fold(name)
    wanted = pattern if case_sensitive else pattern.upper()
    return named(name) & text_matches(subject, wanted, whole)


def regex(subject: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Regular expression found anywhere; an invalid one raises on execution."""
    return subject.rlike(pattern if case_sensitive else f"(?i){pattern}")


def exact_set(subject: Column, values: list[str]) -> Column:
    return subject.isin(*values)


def contains_any(subject: Column, values: list[str]) -> Column:
    return any_of([subject.contains(v) for v in values])


def suffix_set(subject: Column, values: list[str]) -> Column:
    return any_of([subject.endswith(v) for v in values])


def split_path_pattern(pattern: str) -> list[str]:
    normalized = re.sub(r"[/\\]+", r"\\", pattern)
    return [s for s in normalized.split("\\") if s]


def directory_regex(segments: list[str], leaf_any_depth: bool) -> str:
    """Regex over a folded directory path ending in a backslash.

    The first segment may match a directory at any depth, each later one exactly
    one level below; ``**`` stands for one or more levels (none when first).
    """
    level = r"[^\\]+\\"
    parts = [rf"^[A-Z]:\\(?:{level})*"]
    for i, segment in enumerate(segments):
        if segment == "**":
            parts.append(rf"(?:{level})+" if i else "")
        else:
            parts.append(wildcard_regex(segment.upper(), r"[^\\]", r"[^\\]*") + r"\\")
    if leaf_any_depth:
        parts.append(rf"(?:{level})*")
    return "(?s)" + "".join(parts) + "$"

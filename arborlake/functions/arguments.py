"""Readers for user-typed bounds: sizes, times, months, attribute lists.

Each runs once on the driver and yields plain values for literals in the plan.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from arborlake.schema import ATTRIBUTE_NAMES

_UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
_STEPS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august",
           "september", "october", "november", "december")

# Attribute filter presets.
ATTRIBUTE_PRESETS = {
    "system-files": "hidden,system", "system_files": "hidden,system", "sysfiles": "hidden,system",
    "user-files": "!hidden,!system", "user_files": "!hidden,!system", "userfiles": "!hidden,!system",
    "compressed-encrypted": "compressed,encrypted",
    "compressed_encrypted": "compressed,encrypted", "compenc": "compressed,encrypted",
}
_BIT_OF = {name: bit for bit, names in ATTRIBUTE_NAMES.items() for name in names}


def size_bytes(spec: int | str) -> int:
    """Bytes of ``1024``, ``'10MB'``, ``'2 gb'`` (binary units)."""
    if isinstance(spec, int):
        return spec
    found = re.fullmatch(r"\s*(\d+)\s*(B|KB|MB|GB|TB)?\s*", spec, re.IGNORECASE)
    if not found:
        raise ValueError(f"invalid size: {spec!r}")
    return int(found[1]) * _UNITS[(found[2] or "B").upper()]


def _midnight(ts: datetime) -> datetime:
    return ts.replace(hour=0, minute=0, second=0, microsecond=0)


def _add_months(first: datetime, months: int) -> datetime:
    index = first.year * 12 + first.month - 1 + months
    return first.replace(year=index // 12, month=index % 12 + 1, day=1)


def time_bound(spec: str | datetime, as_of: datetime, lower: bool) -> datetime:
    """Instant named by a duration back from ``as_of``, an ISO date (with a time, if wanted) or a range.

    A named range gives its start as a lower bound and its end as an upper one;
    ranges that are still running give their start for both.
    """
    if isinstance(spec, datetime):
        return spec
    key = spec.strip().lower()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}([ t]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?", key):
        return datetime.fromisoformat(key)
    today = _midnight(as_of)
    week = today - timedelta(days=today.weekday())
    month = today.replace(day=1)
    year = today.replace(month=1, day=1)
    day = timedelta(days=1)
    ranges = {
        "today": (today, today),
        "yesterday": (today - day, today),
        "this_week": (week, week),
        "last_week": (week - 7 * day, week),
        "this_month": (month, month),
        "last_month": (_add_months(month, -1), month),
        "this_year": (year, year),
        "ytd": (year, year),
        "last_year": (_add_months(year, -12), year),
        "last_7d": (as_of - 7 * day,) * 2,
        "last_30d": (as_of - 30 * day,) * 2,
        "last_90d": (as_of - 90 * day,) * 2,
        "last_365d": (as_of - 365 * day,) * 2,
        "next_day": (today + day, today + 2 * day),
        "tomorrow": (today + day, today + 2 * day),
        "next_week": (week + 7 * day, week + 14 * day),
        "next_month": (_add_months(month, 1), _add_months(month, 2)),
        "next_year": (_add_months(year, 12), _add_months(year, 24)),
    }
    by_name = {**ranges, **{name.replace("_", ""): span for name, span in ranges.items()}}
    if key in by_name:
        return by_name[key][0 if lower else 1]
    back = re.fullmatch(r"(-?\d+)([smhdw])", key)
    if back:
        return as_of - timedelta(**{_STEPS[back[2]]: int(back[1])})
    raise ValueError(f"invalid time: {spec!r}")


def months(spec: str | list[int]) -> list[int]:
    """Month numbers of ``'jan,Q2'``; unknown words are ignored."""
    if not isinstance(spec, str):
        return sorted(set(spec))
    out: set[int] = set()
    for token in (t.strip().lower() for t in spec.split(",")):
        if re.fullmatch(r"q[1-4]", token):
            first = 3 * int(token[1]) - 2
            out.update(range(first, first + 3))
        else:
            out.update(i for i, name in enumerate(_MONTHS, 1) if token in (name, name[:3]))
    return sorted(out)


def attribute_bit(name: str) -> int:
    """Bit of an attribute name; 0 when unknown."""
    return _BIT_OF.get(name.strip().lower(), 0)


def attribute_masks(spec: str) -> tuple[int, int]:
    """(required bits, excluded bits) of ``'hidden,!system'`` and presets."""
    required = excluded = 0
    for token in (t.strip().lower() for t in spec.split(",")):
        negated, name = token.startswith("!"), token.lstrip("!")
        if name in ATTRIBUTE_PRESETS:
            inner_required, inner_excluded = attribute_masks(ATTRIBUTE_PRESETS[name])
            # A negated preset keeps only its own exclusions.
            required |= 0 if negated else inner_required
            excluded |= inner_excluded
        elif negated:
            excluded |= attribute_bit(name)
        else:
            required |= attribute_bit(name)
    return required, excluded

"""Derived columns: every function maps Columns to a Column, all JVM-side."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions.categories import TYPE_EXTENSIONS
from arborlake.schema import FLAG_BITS, METAFILE_NAMES, PARITY_MASK, field

BULKINESS_SCALE = 1_000_000
LEGACY_PATH_LENGTH = 65_535
MAX_BIGINT = (1 << 63) - 1
KB, MB, GB, TB = 1 << 10, 1 << 20, 1 << 30, 1 << 40


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ext(name: Column | str) -> Column:
    """Lower-case text after the last dot; '' when there is none.

    A leading dot alone or a trailing dot gives no extension.
    """
    lowered = F.lower(_col(name))
    tail = F.substring_index(lowered, ".", -1)
    n = F.char_length(tail)
    return F.when((n > 0) & (n < F.char_length(lowered) - 1), tail).otherwise(F.lit(""))


def type_of_extension(extension: Column) -> Column:
    """Category by one look-up in a constant map, so the generated code stays small."""
    known: dict[str, str] = {"": "file"}
    for category, members in TYPE_EXTENSIONS.items():
        for member in members:
            known.setdefault(member, category)
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, extension), F.lit("other"))


def semantic_type(extension: Column | str, is_directory: Column | str) -> Column:
    """One of 24 categories: directory, file (no extension), 21 lists, other."""
    return (F.when(_col(is_directory), F.lit("directory"))
            .otherwise(type_of_extension(_col(extension))))


def bulkiness(logical: Column | str, allocated: Column | str) -> Column:
    """allocated x 10^6 / logical in whole numbers; 0 when logical is 0, at most the largest BIGINT.

    Quotient and remainder are scaled apart, as their products fit a decimal for all sizes.
    """
    logical, allocated = _col(logical), _col(allocated)
    scale = F.lit(BULKINESS_SCALE).cast("decimal(7,0)")
    scaled = lambda c: c.cast("decimal(19,0)") * scale
    rest = F.call_function("div", scaled(allocated % logical), logical.cast("decimal(19,0)"))
    whole = scaled(F.call_function("div", allocated, logical)) + rest.cast("decimal(19,0)")
    return F.when(logical == 0, F.lit(0).cast("bigint")).otherwise(
        F.least(whole, F.lit(MAX_BIGINT).cast("decimal(27,0)")).cast("bigint"))


def effective_size(is_directory: Column | str, own: Column | str, tree: Column | str) -> Column:
    """Subtree value for directories, own value for files."""
    return F.when(_col(is_directory), _col(tree)).otherwise(_col(own))


def has_flag(flags: Column | str, name: str) -> Column:
    return _col(flags).bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def attribute_flags(flags: Column | str) -> dict[str, Column]:
    """The 19 attribute booleans of a bitmask."""
    return {name: has_flag(flags, name) for name in FLAG_BITS}


def parity_attributes(flags: Column | str) -> Column:
    return _col(flags).bitwiseAND(F.lit(PARITY_MASK))


def name_length(name: Column | str) -> Column:
    return F.char_length(_col(name))


def path_length(path: Column | str, legacy_cut: bool = False) -> Column:
    """Characters of a path; ``legacy_cut`` gives no more than a 16-bit number can hold."""
    n = F.char_length(_col(path))
    return F.least(n, F.lit(LEGACY_PATH_LENGTH)) if legacy_cut else n


def path_only(path: Column | str) -> Column:
    """Path up to and including the last backslash; '' without one."""
    path = _col(path)
    tail = F.substring_index(path, "\\", -1)
    return F.substring(path, F.lit(1), F.char_length(path) - F.char_length(tail))


def is_malformed(name_bytes: Column | str) -> Column:
    """The stored name bytes are not valid UTF-8."""
    return ~F.is_valid_utf8(_col(name_bytes).cast("string"))


def name_hex(name_bytes: Column | str) -> Column:
    """Lower-case hex of the name bytes, for malformed names only."""
    name_bytes = _col(name_bytes)
    return F.when(is_malformed(name_bytes), F.lower(F.hex(name_bytes)))


# Byte sequences in hex: a lone surrogate, one valid character, one stray byte.
_SURROGATE_HEX = "ED[AB].[89AB]."
_CHARACTER_HEX = ("[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|ED[89].[89AB].|E[1-9A-CEF].[89AB].[89AB]."
                  "|E[1-9A-CEF][89AB].[89AB].|F0[9AB].[89AB].[89AB].|F[1-3][89AB].[89AB].[89AB]."
                  "|F48.[89AB].[89AB].")


def render_name(name_bytes: Column | str, normalized: bool = False) -> Column:
    """Readable form of a possibly malformed name.

    Each lone surrogate becomes U+FFFD, or ``<BAD:HHHH>`` with its code unit when
    ``normalized``; any other stray byte becomes U+FFFD or ``<BAD>``.
    """
    raw = _col(name_bytes)
    pieces = F.regexp_extract_all(
        F.hex(raw), F.lit(f"({_SURROGATE_HEX}|{_CHARACTER_HEX}|..)"), F.lit(1))

    def piece(token: Column) -> Column:
        second = F.conv(F.substring(token, 3, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))
        third = F.conv(F.substring(token, 5, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))
        unit = F.lit(0xD000).bitwiseOR(F.shiftleft(second, 6)).bitwiseOR(third)
        mark = F.concat(F.lit("<BAD:"), F.hex(unit), F.lit(">")) if normalized else F.lit("�")
        stray = F.lit("<BAD>" if normalized else "�")
        return (F.when(token.rlike(f"^{_SURROGATE_HEX}$"), F.hex(F.encode(mark, "UTF-8")))
                .when(token.rlike(f"^(?:{_CHARACTER_HEX})$"), token)
                .otherwise(F.hex(F.encode(stray, "UTF-8"))))

    fixed = F.decode(F.unhex(F.array_join(F.transform(pieces, piece), "")), "UTF-8")
    return F.when(is_malformed(raw), fixed).otherwise(raw.cast("string"))


def is_metafile(name: Column | str) -> Column:
    return F.upper(_col(name)).isin(*[n.upper() for n in METAFILE_NAMES])


def is_ads(name: Column | str) -> Column:
    """A record name that carries a named stream."""
    return _col(name).contains(":")


def is_ads_path(path: Column | str) -> Column:
    """A listing path with a colon beyond the drive prefix."""
    return F.substring(_col(path), 3, 1 << 30).contains(":")


def fold(text: Column | str) -> Column:
    """Case folding used by every case-insensitive comparison."""
    return F.upper(_col(text))


def filetime_to_timestamp(ticks: Column | str) -> Column:
    """100-ns ticks since 1601 to a timestamp; 0 means unset and gives NULL."""
    ticks = _col(ticks)
    since_1970 = F.call_function("div", ticks - F.lit(116_444_736_000_000_000), F.lit(10))
    seconds = (since_1970.cast("decimal(24,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(ticks != 0, epoch + F.make_dt_interval(secs=seconds))


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    ts = _col(ts)
    return {part: F.extract(F.lit(part), ts).cast("int")
            for part in ("year", "month", "day", "hour", "minute", "second")}


def shift_seconds(ts: Column | str, offset_seconds: int) -> Column:
    """One fixed time-zone offset for all rows."""
    return _col(ts) + F.make_dt_interval(secs=F.lit(offset_seconds))


def month_of(ts: Column | str) -> Column:
    return F.month(_col(ts))


def _classes(value: Column, bounds, labels) -> Column:
    chain = F.when(value < F.lit(bounds[0]), F.lit(labels[0]))
    for bound, label in zip(bounds[1:], labels[1:]):
        chain = chain.when(value < F.lit(bound), F.lit(label))
    return chain.when(value.isNotNull(), F.lit(labels[-1]))


# Class bounds and labels.
SIZE_BOUNDS = (1_024, 102_400, 1_048_576, 104_857_600, 1_073_741_824, 10_737_418_240)
SIZE_LABELS = ("0 – 1 KB", "1 KB – 100 KB", "100 KB – 1 MB", "1 MB – 100 MB",
               "100 MB – 1 GB", "1 GB – 10 GB", "> 10 GB")
SIZE8_BOUNDS = (KB, 10 * KB, 100 * KB, MB, 10 * MB, 100 * MB, GB)
AGE_BOUND_DAYS = (1, 7, 30, 90, 365, 1_095, 3_650)
AGE_LABELS = ("Today", "This week", "This month", "Last 90 days", "This year",
              "1 – 3 years", "3 – 10 years", "> 10 years")
PATH_RISK_BOUNDS = (128, 200, 260)
PATH_RISK_LABELS = ("< 128 chars", "128 – 199 chars", "200 – 259 chars", "≥ 260 chars")


def size_bucket(size: Column | str) -> Column:
    return _classes(_col(size), SIZE_BOUNDS, SIZE_LABELS)


def size_bucket8(size: Column | str) -> Column:
    return _classes(_col(size), SIZE8_BOUNDS, range(8))


def micros(ts: Column) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session time zone."""
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint")
    seconds = (F.extract(F.lit("second"), ts) * 1_000_000).cast("bigint")
    return F.unix_date(ts.cast("date")) * F.lit(86_400_000_000) + minutes * F.lit(60_000_000) + seconds


def age_bucket(ts: Column | str, as_of: datetime) -> Column:
    """Age class of a timestamp relative to ``as_of``."""
    age = micros(F.lit(as_of).cast("timestamp_ntz")) - micros(_col(ts))
    return _classes(age, [d * 86_400_000_000 for d in AGE_BOUND_DAYS], AGE_LABELS)


def path_risk(length: Column | str) -> Column:
    return _classes(_col(length), PATH_RISK_BOUNDS, PATH_RISK_LABELS)


def normalize_path(path: Column | str) -> Column:
    """Comparison form of a listing path: lower case, '/', no trailing '/'."""
    return F.rtrim(F.translate(F.lower(_col(path)), "\\", "/"), F.lit("/"))


def display_time(ts: Column | str, offset_seconds: int = 0) -> Column:
    return F.coalesce(F.date_format(shift_seconds(ts, offset_seconds), "yyyy-MM-dd HH:mm:ss"),
                      F.lit(""))


def display_flag(flag: Column, pos: str = "1", neg: str = "0") -> Column:
    return F.when(flag, F.lit(pos)).otherwise(F.lit(neg))


def human_size(size: Column | str) -> Column:
    """'512 B', '1.3 MB', '2.50 GB'; exact halves round to even."""
    size = _col(size)

    def scaled(unit: int, name: str, digits: int) -> Column:
        value = F.bround(size.cast("double") / F.lit(float(unit)), digits)
        return F.format_string(f"%.{digits}f {name}", value)

    return (F.when(size >= TB, scaled(TB, "TB", 2))
            .when(size >= GB, scaled(GB, "GB", 2))
            .when(size >= MB, scaled(MB, "MB", 1))
            .when(size >= KB, scaled(KB, "KB", 1))
            .otherwise(F.concat(size.cast("string"), F.lit(" B"))))


def grouped_digits(number: Column | str) -> Column:
    return F.format_number(_col(number), 0)


# Change reason bits and their short names.
REASON_CREATE, REASON_DELETE, REASON_RENAME = 0x100, 0x200, 0x2000
REASON_SIZE, REASON_METADATA, REASON_CLOSE = 0x2 | 0x4, 0x8000, 0x8000_0000
REASON_NAMES = (
    (REASON_CREATE, "CREATE"), (REASON_DELETE, "DELETE"), (REASON_RENAME, "RENAME"),
    (REASON_SIZE, "SIZE"), (REASON_METADATA, "META"), (REASON_CLOSE, "CLOSE"),
)


def reason_has(reason: Column | str, mask: int) -> Column:
    return _col(reason).cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")) != 0


def reason_names(reason: Column | str) -> Column:
    """Names of the set reason bits joined by '+', else the mask in hex."""
    names = F.concat_ws("+", *[F.when(reason_has(reason, m), F.lit(n)) for m, n in REASON_NAMES])
    return F.when(names != "", names).otherwise(
        F.concat(F.lit("0x"), F.lpad(F.hex(_col(reason).cast("bigint")), 8, "0")))


def link_share(value: Column | str, i: Column, n: Column) -> Column:
    """Part of ``value`` counted for link ``i`` of ``n``; the parts sum to it.

    floor(v(i+1)/n) - floor(v i/n), with v = qn + r to stay inside 64 bits.
    """
    value = _col(value)
    quotient = F.call_function("div", value, n)
    rest = value % n
    part = (quotient + F.call_function("div", rest * (i + 1), n) - F.call_function("div", rest * i, n))
    return F.when(n <= 1, value).otherwise(part)


def field_column(df: DataFrame, name: str) -> Column:
    """Column of any catalog field, from stored or derived columns of ``df``."""
    f = field(name)
    if f.column:
        return F.col(f.column)
    stored = set(df.columns)
    if f.name in stored:
        return F.col(f.name)
    extension = F.col("ext") if "ext" in stored else ext("name")
    if f.name in FLAG_BITS:
        return F.col("is_directory") if f.name == "directory_flag" else has_flag("flags", f.name)
    match f.name:
        case "extension":
            return extension
        case "type":
            return semantic_type(extension, "is_directory")
        case "path_only":
            return path_only("path")
        case "path_length":
            return path_length("path")
        case "name_length":
            return name_length("name")
        case "attributes" | "attribute_value":
            return F.col("flags")
        case "parity_attributes":
            return parity_attributes("flags")
        case "bulkiness":
            if "treesize" in stored:
                return bulkiness(effective_size("is_directory", "size", "treesize"),
                                 effective_size("is_directory", "allocated_size", "tree_allocated"))
            return bulkiness("size", "allocated_size")
        case "malformed":
            return is_malformed("name_bytes")
        case "name_hex":
            return name_hex("name_bytes")
    return F.col(f.name)


def derive(df: DataFrame, fields: list[str]) -> DataFrame:
    """Add the named fields as columns."""
    return df.withColumns({field(n).name: field_column(df, n) for n in fields})


def with_extension(df: DataFrame) -> DataFrame:
    """Store the extension once, for repeated lookups and file pruning."""
    return df.withColumn("ext", ext("name"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

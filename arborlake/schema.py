"""Catalog schema and the shared field list.

A catalog is a DataFrame with one row per file or directory record.  The key is
(drive, frs); the hierarchy is an adjacency list through ``parent_frs``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ROOT_FRS = 5
# Walks up the tree stop at either of these ids.
ROOT_IDS = (0, 5)
# Records 0..15 are reserved for volume metadata, the root excepted.
LAST_RESERVED_FRS = 15

LINK_STRUCT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("parent_frs", T.LongType()),
    T.StructField("namespace", T.IntegerType()),
])

STREAM_STRUCT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("allocated_size", T.LongType()),
    T.StructField("is_sparse", T.BooleanType()),
    T.StructField("is_compressed", T.BooleanType()),
    T.StructField("is_resident", T.BooleanType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("drive", T.StringType()),
    T.StructField("frs", T.LongType()),
    T.StructField("parent_frs", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("is_directory", T.BooleanType()),
    T.StructField("size", T.LongType()),
    T.StructField("allocated_size", T.LongType()),
    T.StructField("created", T.TimestampNTZType()),
    T.StructField("modified", T.TimestampNTZType()),
    T.StructField("accessed", T.TimestampNTZType()),
    T.StructField("link_count", T.IntegerType()),
    T.StructField("flags", T.IntegerType()),
])

# Attribute bits of a record.
FLAG_BITS = {
    "read_only": 0x0001,
    "hidden": 0x0002,
    "system": 0x0004,
    "directory_flag": 0x0010,
    "archive": 0x0020,
    "temporary": 0x0100,
    "sparse": 0x0200,
    "reparse": 0x0400,
    "compressed": 0x0800,
    "offline": 0x1000,
    "not_indexed": 0x2000,
    "encrypted": 0x4000,
    "integrity": 0x8000,
    "virtual": 0x0001_0000,
    "no_scrub": 0x0002_0000,
    "recall_on_open": 0x0004_0000,
    "pinned": 0x0008_0000,
    "unpinned": 0x0010_0000,
    "recall_on_data_access": 0x0040_0000,
}

# Fixed value: the attribute bits kept by the legacy listing layout.
PARITY_MASK = 0x001A_EE37

# Names accepted in attribute filters.
ATTRIBUTE_NAMES = {
    0x0001: ("readonly", "read-only", "r"),
    0x0002: ("hidden", "h"),
    0x0004: ("system", "s"),
    0x0010: ("directory", "dir", "d"),
    0x0020: ("archive", "a"),
    0x0040: ("device",),
    0x0080: ("normal",),
    0x0100: ("temporary", "temp", "t"),
    0x0200: ("sparse",),
    0x0400: ("reparse",),
    0x0800: ("compressed", "c"),
    0x1000: ("offline", "o"),
    0x2000: ("notindexed", "notcontent", "n"),
    0x4000: ("encrypted", "e"),
    0x8000: ("integrity", "i"),
    0x0001_0000: ("virtual", "v"),
    0x0002_0000: ("noscrub", "no_scrub_data", "x"),
    0x0008_0000: ("pinned", "p"),
    0x0010_0000: ("unpinned", "u"),
}

# Reserved volume metadata names.
METAFILE_NAMES = (
    "$MFT", "$MFTMirr", "$LogFile", "$Volume", "$AttrDef", "$Bitmap", "$Boot",
    "$BadClus", "$Secure", "$UpCase", "$Extend", "$ObjId", "$Quota", "$Reparse",
    "$UsnJrnl", "$RmMetadata", "$Deleted", "$Repair", "$Tops", "$TxfLog", "$Txf",
)


@dataclass(frozen=True)
class Field:
    """One searchable, sortable or groupable property of a record."""

    name: str
    kind: str                   # enum | string | numeric | timestamp | bitmask | bool
    display: str
    aliases: tuple[str, ...] = ()
    column: str | None = None   # stored column, when the field is one
    sortable: bool = True
    descending: bool = False    # default sort direction
    filterable: bool = True
    groupable: bool = False
    default_top: int = 0
    needs: str | None = None    # "path" or "tree" when extra columns must be joined

    @property
    def aggregatable(self) -> bool:
        return self.kind in ("numeric", "timestamp")


def _text(name, display, aliases=(), **kw):
    return Field(name, kw.pop("kind", "string"), display, aliases, **kw)


def _number(name, display, aliases=(), column=None, needs=None):
    return Field(name, "numeric", display, aliases, column, descending=True, needs=needs)


def _time(name, display, aliases=()):
    return Field(name, "timestamp", display, aliases, name, descending=True)


def _flag(name, display, aliases=(), needs=None):
    return Field(name, "bool", display, aliases, descending=True, groupable=True,
                 default_top=2, needs=needs)


def _mask(name, display, aliases=(), filterable=False):
    return Field(name, "bitmask", display, aliases, sortable=False, filterable=filterable)


_FIELD_LIST = (
    _text("drive", "Drive", ("drv",), kind="enum", column="drive", groupable=True, default_top=26),
    _text("path", "Path", needs="path"),
    _text("name", "Name", column="name", groupable=True, default_top=100),
    _text("path_only", "Path Only", ("pathonly", "path only"), groupable=True, default_top=30,
          needs="path"),
    _number("size", "Size", column="size"),
    _number("size_on_disk", "Size on Disk", ("sizeondisk", "size on disk", "allocated"),
            column="allocated_size"),
    _time("created", "Created"),
    _time("modified", "Last Written", ("written", "date")),
    _time("accessed", "Last Accessed"),
    _text("extension", "Extension", ("ext",), groupable=True, default_top=50),
    _text("type", "Type", ("folder",), kind="enum", groupable=True, default_top=30),
    _mask("attributes", "Attributes", ("attrs",)),
    _mask("attribute_value", "AttributeValue", ("attributevalue", "attrval"), filterable=True),
    _flag("hidden", "Hidden", ("h",)),
    _flag("system", "System", ("s",)),
    _flag("archive", "Archive", ("a",)),
    _flag("read_only", "Read-only", ("readonly", "read-only", "read only", "r")),
    _flag("compressed", "Compressed"),
    _flag("encrypted", "Encrypted"),
    _flag("sparse", "Sparse"),
    _flag("reparse", "Reparse"),
    _flag("offline", "Offline", ("o",)),
    _flag("not_indexed", "Not content indexed file", ("notindexed", "not indexed", "notcontent", "not content indexed",
           "not content indexed file")),
    _flag("temporary", "Temporary", ("temp",)),
    _flag("virtual", "Virtual"),
    _flag("pinned", "Pinned"),
    _flag("unpinned", "Unpinned"),
    _number("descendants", "Descendants", ("decendents",), column="descendants", needs="tree"),
    _number("tree_size", "Tree Size", ("treesize",), column="treesize", needs="tree"),
    _number("tree_allocated", "Tree Allocated", ("treeallocated",), column="tree_allocated",
            needs="tree"),
    _number("bulkiness", "Bulkiness", needs="tree"),
    _flag("integrity", "Integrity"),
    _flag("no_scrub", "No scrub file", ("noscrub", "no scrub", "no scrub file")),
    _flag("directory_flag", "Directory Flag", ("directoryflag", "directory flag", "directory", "dir")),
    _flag("recall_on_open", "Recall on open", ("recallonopen", "recall on open")),
    _flag("recall_on_data_access", "Recall on data access",
          ("recallondataaccess", "recall on data access")),
    _mask("parity_attributes", "Attributes", ("parityattributes",)),
    _number("name_length", "Name Length", ("namelength", "name_len", "namelen")),
    _number("path_length", "Path Length", ("pathlength", "path_len", "pathlen"), needs="path"),
    _flag("malformed", "Malformed", ("ill_formed", "illformed", "bad_name")),
    _flag("malformed_path", "Malformed Path", ("malformedpath", "ill_formed_path", "bad_path"),
          needs="path"),
    Field("name_hex", "string", "Name (hex)", ("namehex", "name_bytes_hex"), sortable=False,
          filterable=False),
)

FIELDS: dict[str, Field] = {f.name: f for f in _FIELD_LIST}

_LOOKUP = {key: f for f in _FIELD_LIST for key in (f.name, *f.aliases)}


def find_field(name: str) -> Field | None:
    """Field for a canonical name or alias, ignoring case; None when unknown."""
    return _LOOKUP.get(name.strip().lower())


def field(name: str) -> Field:
    found = find_field(name)
    if found is None:
        raise ValueError(f"unknown field: {name!r}")
    return found


# Column order of the full listing and of the legacy listing.
ALL_COLUMNS = (
    "path", "name", "path_only", "size", "size_on_disk", "created", "modified", "accessed",
    "descendants", "read_only", "hidden", "system", "directory_flag", "archive", "sparse",
    "reparse", "compressed", "offline", "not_indexed", "encrypted", "integrity", "no_scrub",
    "recall_on_open", "pinned", "unpinned", "recall_on_data_access", "attributes", "tree_size",
    "tree_allocated", "bulkiness", "type", "extension", "name_length", "path_length",
)
PARITY_COLUMNS = (
    "path", "name", "path_only", "size", "size_on_disk", "created", "modified", "accessed",
    "descendants", "read_only", "archive", "system", "hidden", "offline", "not_indexed",
    "no_scrub", "integrity", "pinned", "unpinned", "directory_flag", "compressed", "encrypted",
    "sparse", "reparse", "parity_attributes",
)

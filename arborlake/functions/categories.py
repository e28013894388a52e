"""Extension categories and collections."""

from __future__ import annotations

# Extensions per semantic type.  Membership is tested in this
# order, so an extension listed twice belongs to the first type.
TYPE_EXTENSIONS: dict[str, tuple[str, ...]] = {
    "document": ("doc", "docx", "pdf", "txt", "rtf", "odt", "xls", "xlsx", "ppt", "pptx", "csv", "md"),
    "picture": ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "svg", "ico", "raw", "heic"),
    "video": ("mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "mpeg", "mpg", "m4v", "3gp"),
    "audio": ("mp3", "wav", "flac", "aac", "ogg", "wma", "m4a", "opus", "aiff"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "iso"),
    "code": ("rs", "py", "js", "ts", "java", "c", "cpp", "h", "hpp", "go", "rb", "php", "swift", "kt"),
    "executable": ("exe", "msi", "bat", "cmd", "ps1", "com", "scr"),
    "script": ("sh", "bash", "zsh", "fish", "csh", "ksh", "awk", "sed", "lua", "pl", "pm", "tcl"),
    "web": ("html", "htm", "css", "scss", "less", "sass", "jsx", "tsx", "vue", "svelte", "wasm", "xhtml"),
    "font": ("ttf", "otf", "woff", "woff2", "eot", "fon"),
    "database": ("db", "sqlite", "sqlite3", "mdb", "accdb", "sql", "ldf", "mdf", "ndf", "dbf"),
    "config": ("ini", "cfg", "conf", "yaml", "yml", "toml", "json", "xml", "env", "properties",
               "reg", "inf", "plist"),
    "log": ("log", "out", "err", "trace", "evt", "evtx"),
    "backup": ("bak", "old", "orig", "swp", "tmp", "temp", "~"),
    "disk": ("vmdk", "vhd", "vhdx", "vdi", "qcow2", "img", "wim", "iso", "dmg"),
    "data": ("csv", "tsv", "parquet", "avro", "arrow", "ndjson", "jsonl", "dat", "sav", "hdf5"),
    "cad": ("dwg", "dxf", "step", "stp", "stl", "obj", "fbx", "blend", "3ds", "gltf", "glb"),
    "shortcut": ("lnk", "url", "desktop", "webloc"),
    "system": ("sys", "dll", "drv", "ocx", "cpl", "ax", "mui"),
    "cert": ("pem", "crt", "cer", "der", "pfx", "p12", "key", "csr", "jks"),
    "ebook": ("epub", "mobi", "azw", "azw3", "djvu", "cbr", "cbz"),
}

# Types that depend on the row, not on an extension list.
ROW_TYPES = ("directory", "file", "other")

# Collection names accepted in extension filters.
_EXECUTABLE_COLLECTION = ("exe", "msi", "bat", "cmd", "ps1", "com", "scr", "vbs", "wsf", "dll", "sys")
COLLECTIONS: dict[str, tuple[str, ...]] = {
    "pictures": TYPE_EXTENSIONS["picture"], "images": TYPE_EXTENSIONS["picture"],
    "documents": TYPE_EXTENSIONS["document"], "docs": TYPE_EXTENSIONS["document"],
    "videos": TYPE_EXTENSIONS["video"], "video": TYPE_EXTENSIONS["video"],
    "music": TYPE_EXTENSIONS["audio"], "audio": TYPE_EXTENSIONS["audio"],
    "archives": TYPE_EXTENSIONS["archive"], "compressed": TYPE_EXTENSIONS["archive"],
    "code": TYPE_EXTENSIONS["code"], "source": TYPE_EXTENSIONS["code"],
    "executables": _EXECUTABLE_COLLECTION, "exec": _EXECUTABLE_COLLECTION,
}


def type_extensions(category: str) -> tuple[str, ...] | None:
    """Extensions of a category; None for directory, file and other."""
    return TYPE_EXTENSIONS.get(category.lower())


def expand_extensions(spec: str | list[str] | tuple[str, ...]) -> list[str]:
    """Extension list with collection names replaced by their members."""
    tokens = spec.split(",") if isinstance(spec, str) else spec
    out: list[str] = []
    for token in tokens:
        token = token.strip().lstrip(".").lower()
        if token:
            out.extend(COLLECTIONS.get(token, (token,)))
    return list(dict.fromkeys(out))

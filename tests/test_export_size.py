import json

import pytest

from arborlake import Catalog
from arborlake.operators import hierarchy as h
from arborlake.schema import ALL_COLUMNS
from arborlake.sources import catalog_io, sinks


def parts(folder):
    return sorted(f for f in folder.rglob("part-*") if f.is_file())


def test_json_is_written_small(small, tmp_path):
    """Names of columns repeat in every row; packed, they take no room."""
    catalog = Catalog(small)
    columns = ["path", "size", "modified", "hidden", "type"]
    packed, plain = tmp_path / "packed", tmp_path / "plain"
    many = catalog.with_paths().coalesce(1)
    for _ in range(6):
        many = many.union(many).coalesce(1)
    sinks.export(many, str(packed), fmt="json", columns=columns)
    sinks.export(many, str(plain), fmt="json", columns=columns, compression="none")
    sizes = [sum(f.stat().st_size for f in parts(x)) for x in (packed, plain)]
    assert all(f.name.endswith(".json.gz") for f in parts(packed)) and 5 * sizes[0] < sizes[1]
    spark = small.sparkSession
    schema = "Path string, Size long, `Last Written` string, Hidden string, Type string"
    rows = [sorted(map(tuple, catalog_io.read_listing(spark, str(x), "json", schema).collect()), key=str) for x in (packed, plain)]
    assert rows[0] == rows[1] and len(rows[0]) == 64 * small.count()
    assert [json.loads(line) for f in parts(plain) for line in f.read_text().splitlines()][0].keys() <= {
        "Path", "Size", "Last Written", "Hidden", "Type"}


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_sums_are_built_only_for_what_shows_them(small, tmp_path, monkeypatch, fmt):
    expected = Catalog(small)
    expected.export(str(tmp_path / "with"), fmt=fmt, columns="path,size,descendants")
    monkeypatch.setattr(h, "tree_sums", None)
    catalog = Catalog(small)
    catalog.export(str(tmp_path / "out"), fmt=fmt, columns="path,size")
    read = lambda x: sorted((r.Path, r.Size) for r in catalog_io.read_listing(
        small.sparkSession, str(tmp_path / x), fmt, "Path string, Size long" + (", Descendants long" if x == "with" else "")).collect())
    assert read("out") == read("with") and len(read("out")) == small.count()


def test_what_needs_sums():
    tree = {"descendants", "tree_size", "tree_allocated", "bulkiness"}
    assert {c for c in ALL_COLUMNS if sinks.needs_tree([c])} >= tree & set(ALL_COLUMNS)
    assert sinks.needs_tree("all") and sinks.needs_tree() and sinks.needs_tree(legacy=True)
    assert sinks.needs_tree("path,size", legacy=True) and not sinks.needs_tree("path,name", legacy=True)
    assert not sinks.needs_tree("path,size,size_on_disk,modified,hidden,type")

"""Token-id files: each document's ids compressed by itself with a zstandard dictionary that all share.

A folder holds ``dictionary.zdict``, data files of compressed documents in ascending id order, and the Parquet
tables ``index`` (a row for each document: file, offset, length, first token) and ``header``. Any document is
read with one look in the index and one short read, as no document needs its neighbours.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from arborlake.llm.common import byte_rows, range_bounds, range_bucket, shuffle_partitions

#: Texts (those with the least hashes) and their longest part that the dictionary is trained on; it only
#: makes files smaller, every document is encoded and compressed whole.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 4096, 64 << 10
#: Distinct units, and pieces of them, whose ids a worker remembers.
CACHE_UNITS = 600_000
# Fixed value: the pattern by which byte-level vocabularies split a text into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs that often follow a word and are a piece of their own.
SIGNS = frozenset(",.;:!?")
#: Bytes of compressed documents that a range of ids, and so a data file, has on average.
FILE_BYTES = 32 << 20


class _Memory(dict):
    """Remembers what ``make`` gives for a key; emptied between texts once it has CACHE_UNITS keys."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    A byte-level vocabulary splits a text before a space that stands between two other characters, whatever
    surrounds it, so ids of the units between such spaces can be remembered, and so can those of the pieces that
    the vocabulary's pattern finds in a unit. The library's model is asked for new pieces only. Texts with white
    space before a space or with a space at their end, units with an added token, and other kinds of vocabulary are
    encoded whole.
    """

    def __init__(self, path: str):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path) as f:
            kind = json.load(f)
        split = kind["pre_tokenizer"] or {}
        self.by_piece = (kind["model"]["type"] == "BPE" and not kind["normalizer"] and split.get("type") == "ByteLevel"
                         and split["use_regex"] and not split["add_prefix_space"])
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.plain = not any(a.isalpha() or a[:-1].isalpha() or a[:-1] == "" for a in self.added)
        self.find = regex.compile(PIECE).findall
        self.signs = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        self.signs |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in self.signs)}
        self.units, self.pieces = _Memory(self._unit), _Memory(self._piece)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.signs))
        return array("I", [t.id for t in found]).tobytes()

    def _unit(self, unit: str) -> bytes | None:
        """Ids of a space and ``unit``; None if the cut after the unit is no end of a piece."""
        if not unit or unit[-1].isspace():
            return None
        # Letters alone are one piece, and so is one sign after them; no added token has that form.
        if unit.isalpha() and self.plain:
            return self.pieces[" " + unit]
        if unit[-1] in SIGNS and unit[:-1].isalpha() and self.plain:
            return self.pieces[" " + unit[:-1]] + self.pieces[unit[-1]]
        if any(a in unit for a in self.added):
            return self.whole(" " + unit)
        return b"".join(map(self.pieces.__getitem__, self.find(" " + unit)))

    def encode(self, text: str) -> bytes:
        if not text or not self.by_piece:
            return self.whole(text)
        for memory in (self.units, self.pieces):
            if len(memory) > CACHE_UNITS:
                memory.clear()
        first, *rest = text.split(" ")
        if first[-1:].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.units.__getitem__, rest))
        except TypeError:  # a unit that is None
            return self.whole(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that units are remembered from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, pack: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """Rows (bucket, doc_id, n_tokens, frame) of rows (bucket, doc_id, text); ``pack`` makes the packer of a task."""
    end = array("I", [end_id]).tobytes()

    def run(batches):
        import pyarrow as pa

        coder, packer = encoder(tokenizer), pack()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                data = [coder.encode(t or "") + end for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("bucket"), part.column("doc_id"), pa.array([len(d) // 4 for d in data], pa.int64()),
                     pa.array([packer(d) for d in data], pa.binary())], names=["bucket", "doc_id", "n_tokens", "frame"])

    return docs.mapInArrow(run, "bucket int, doc_id long, n_tokens long, frame binary")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = 0) -> bytes:
    """A zstandard dictionary of the id arrays of the SAMPLE_DOCS rows whose ids have the least hashes."""
    import zstandard

    order = F.xxhash64("doc_id")
    least = docs.select(order.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if least is None:
        return b""
    some = docs.filter(order <= least).limit(SAMPLE_DOCS).select(F.lit(0).alias("bucket"), "doc_id", "text")
    cut = SAMPLE_IDS * 4
    samples = [r.frame for r in _encoded(some, tokenizer, end_id, lambda: lambda d: d[:cut]).select("frame").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too few or too equal samples: the files work without a dictionary
        return b""


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _dictionary(path: str, digest: str):
    """The dictionary of a folder, or None if it has none; refuses one of other contents."""
    import hashlib

    import zstandard

    files, root = _filesystem(path)
    with files.open_input_stream(f"{root}/dictionary.zdict") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the dictionary in {path} is not the one its documents were compressed with")
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Writes the ids of all rows of ``docs``, ``end_id`` after each, to the new folder ``path``.

    Documents are in ascending id order, nulls first; rows with equal ids follow each other in the order of
    their compressed bytes. A null text counts as empty and has the end id alone. A task that runs again writes
    files of another name; the index names those of the attempt that Spark committed.
    """
    import hashlib

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files, root = _filesystem(path)
    files.create_dir(root, recursive=True)
    shared = train_dictionary(rows, tokenizer, end_id)
    with files.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(shared)
    digest = hashlib.sha256(shared).hexdigest()
    spark.createDataFrame([(digest, tokenizer, end_id, 1)], "dictionary_sha256 string, tokenizer string, end_id int, version int") \
        .coalesce(1).write.parquet(f"{path}/header")

    def pack():
        import zstandard

        return zstandard.ZstdCompressor(level=1, dict_data=_dictionary(path, digest), write_content_size=True).compress

    def save(batches):
        import pyarrow as pa

        files, root = _filesystem(path)
        bucket, name, out, at, first = None, None, None, 0, 0
        try:
            for batch in batches:
                index = []
                for b, doc_id, n, frame in byte_rows([batch], "bucket", "doc_id", "n_tokens", "frame"):
                    if b != bucket:
                        if out:
                            out.close()
                        bucket, name, at, first = b, f"data-{b:07d}-{uuid.uuid4().hex}.tok", 0, 0
                        out = files.open_output_stream(f"{root}/{name}")
                    out.write(frame)
                    index.append((b, name, at, len(frame), doc_id, first, n))
                    at += len(frame)
                    first += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (
                    pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))] if index else
                    [pa.array([], t) for t in (pa.int32(), pa.string(), *[pa.int64()] * 5)], names=names)
        finally:
            if out:
                out.close()

    names = ["bucket", "file", "offset", "length", "doc_id", "first", "n_tokens"]
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # About a byte of compressed ids for each character.
    bounds = range_bounds(rows, "doc_id", max(1, size // FILE_BYTES, min(shuffle_partitions(spark), size >> 20)))
    placed = rows.select(range_bucket(F.col("doc_id"), bounds).alias("bucket"), "doc_id", "text")
    ordered = (_encoded(placed, tokenizer, end_id, pack).repartition(max(1, len(bounds)), "bucket")
               .sortWithinPartitions("bucket", "doc_id", "frame"))
    ordered.mapInArrow(save, "bucket int, file string, offset long, length long, doc_id long, first long, n_tokens long") \
        .write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a written folder; ``ids`` as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. Only one row for each data file is brought together.
    """
    digest = spark.read.parquet(f"{path}/header").first()["dictionary_sha256"]
    index = spark.read.parquet(f"{path}/index")

    def load(batches):
        import pyarrow as pa
        import zstandard

        files, root = _filesystem(path)
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(path, digest)).decompress
        name, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = []
                for f, offset, length in byte_rows([part], "file", "offset", "length"):
                    if f.decode() != name:
                        if source:
                            source.close()
                        name = f.decode()
                        source = files.open_input_file(f"{root}/{name}")
                    ids.append(unpack(source.read_at(length, offset)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), part.column("n_tokens"),
                                                  pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
        if source:
            source.close()

    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (index.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
              .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    placed = (index.join(starts, "bucket").withColumn("start", F.col("base") + F.col("first"))
              .repartition(4 * shuffle_partitions(spark), "file").sortWithinPartitions("file", "offset"))
    return placed.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def documents(spark: SparkSession, path: str, ids: list[int]) -> dict[int, list[int]]:
    """Token ids of a few documents by short reads, without touching the rest of the files."""
    import zstandard

    digest = spark.read.parquet(f"{path}/header").first()["dictionary_sha256"]
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(path, digest)).decompress
    files, root = _filesystem(path)
    out = {}
    for r in spark.read.parquet(f"{path}/index").filter(F.col("doc_id").isin(list(ids))).collect():
        with files.open_input_file(f"{root}/{r.file}") as f:
            out[r.doc_id] = array("I", unpack(f.read_at(r.length, r.offset))).tolist()
    return out

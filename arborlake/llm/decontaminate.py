"""Benchmark decontamination by a positional inverted index of the training texts.

The index is split by document: a block holds the posting lists of about BLOCK_TOKENS words, so that all
lists that a phrase needs lie in one block and no list grows with the corpus. A search looks at each block
once: the occurrences of every window's rarest word are the first candidates, and each further word, the
rarest first, keeps those candidates whose offset-adjusted position is on its own list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborlake.llm.common import byte_rows, shuffle_partitions
from arborlake.runtime import materialize

#: Words of a block; a longer text is a block of its own.
BLOCK_TOKENS = 1_000_000
#: Test words that one pass over the index looks for; more items are searched in further passes.
PASS_WORDS = 2_000_000
#: Bytes of a text to bytes of words: A-Z lower-cased, other ASCII but digits and letters a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

INDEX = "block long, term string, doc_id long, base long, n long, positions binary"


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def _pack(positions) -> bytes:
    """Ascending positions as compressed differences."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(positions, prepend=0).astype("<u4").tobytes())


def _unpack(data: bytes):
    import numpy as np
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<u4"), dtype=np.int64)


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The written index of all rows of ``docs``.

    A row with a null ``term`` is a document: its id, first position in the block (``base``) and number of
    words (``n``). Other rows are the posting list of a term in a block. With a ``vocabulary`` only its
    words get lists; words of no test item would never be read.
    """
    known = None if vocabulary is None else {w: i for i, w in enumerate(sorted(vocabulary))}

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = {} if known is None else known
        part, made, at, starts, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            nonlocal made, at
            block = (part << 32) + made
            made += 1
            flat = np.concatenate(ids)
            order = np.flatnonzero(flat >= 0)
            order = order[np.argsort(flat[order], kind="stable")]
            terms, first = np.unique(flat[order], return_index=True)
            lists = np.split(order, first[1:]) if len(terms) else []
            words = list(names)
            rows = [(block, None, d, b, n, None) for d, b, n in starts]
            rows += [(block, words[t].decode(), None, None, len(p), _pack(p)) for t, p in zip(terms.tolist(), lists)]
            starts.clear(), ids.clear()
            at = 0
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[i:i + 20_000]), (
                        pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["block", "term", "doc_id", "base", "n", "positions"])

        for doc_id, text in byte_rows(batches, "id", "text"):
            found = tokens(text)
            starts.append((doc_id, at, len(found)))
            if known is None:
                ids.append(np.fromiter((names.setdefault(w, len(names)) for w in found), np.int64, len(found)))
            else:
                ids.append(np.fromiter((names.get(w, -1) for w in found), np.int64, len(found)))
            ids.append(np.array([-1]))  # no phrase runs into the next document
            at += len(found) + 1
            if at >= BLOCK_TOKENS:
                yield from flush()
                if known is None:
                    names = {}
        if starts:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, INDEX), "postings")


class Windows:
    """Test windows as rows of term numbers, each with its words ordered from the rarest on."""

    def __init__(self, items: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], length: int):
        import numpy as np

        distinct: dict[tuple, set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        for item, words in items:
            size = min(length, len(words))
            for at in range(len(words) - size + 1 if words else 0):
                distinct.setdefault(tuple(words[at:at + size]), set()).add(number[item])
        # A window with a word that no document has can't occur.
        distinct = {w: i for w, i in distinct.items() if all(x in frequency for x in w)}
        self.terms = sorted({x for w in distinct for x in w})
        ids = {x: k for k, x in enumerate(self.terms)}
        count, wide = len(distinct), max(map(len, distinct), default=1)
        self.size = np.array([len(w) for w in distinct], dtype=np.int64)
        self.term, self.offset = np.full((count, wide), -1, np.int64), np.zeros((count, wide), np.int64)
        for row, w in enumerate(distinct):
            for rank, (_, at, x) in enumerate(sorted((frequency[x], at, x) for at, x in enumerate(w))):
                self.term[row, rank], self.offset[row, rank] = ids[x], at
        self.owners = [np.array(sorted(i), dtype=np.int64) for i in distinct.values()]


def _block_matches(w: Windows, lists: dict[int, object], slop: int | None):
    """(window, first position) of every phrase, and of every proximity match, in one block."""
    import numpy as np

    none = np.zeros(0, np.int64)
    if not lists or not len(w.size):
        return none, none, none, none
    order = sorted(lists)
    keys = np.concatenate([lists[t] + (t << 32) for t in order])
    sizes = np.zeros(len(w.terms) + 1, np.int64)
    sizes[order] = [len(lists[t]) for t in order]
    seeds = sizes[w.term[:, 0]]
    window = np.repeat(np.arange(len(w.size)), seeds)
    if not len(window):
        return none, none, none, none
    seed = np.concatenate([lists[t] for t in w.term[seeds > 0, 0].tolist()])
    start = seed - w.offset[window, 0]

    def keep(rows, low, high, rank):
        """Whether the word of this rank has a position from low to high."""
        term = w.term[rows, rank]
        wanted = (term << 32) + np.maximum(low, 0)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return (term < 0) | ((keys[at] >= wanted) & (keys[at] <= (term << 32) + high))

    rows, first = window[start >= 0], start[start >= 0]
    for rank in range(1, w.term.shape[1]):
        at = first + w.offset[rows, rank]
        held = keep(rows, at, at, rank)
        rows, first = rows[held], first[held]
    near, where = (window, seed) if slop is not None else (none, none)
    for rank in range(1, w.term.shape[1] if slop is not None else 1):
        held = keep(near, where - slop, where + slop, rank)
        near, where = near[held], where[held]
    return rows, first, near, where


def _search(windows, slop):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        w = windows.value
        number = {x.decode(): k for k, x in enumerate(w.terms)}
        owned = np.array([len(o) for o in w.owners], dtype=np.int64)
        flat = np.concatenate(w.owners) if w.owners else np.zeros(0, np.int64)
        begin = np.cumsum(owned) - owned

        def items(bases, rows, first):
            """For each document the numbers of its items, ascending."""
            doc = np.searchsorted(bases, first, side="right") - 1
            n = owned[rows]
            owner = flat[np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pairs = np.unique(np.repeat(doc, n) * len(w.items) + owner)
            out: dict[int, list[str]] = {}
            for p in pairs.tolist():
                out.setdefault(p // len(w.items), []).append(w.items[p % len(w.items)])
            return out

        def solve(block, docs, lists):
            docs.sort(key=lambda d: d[1])
            bases = np.array([d[1] for d in docs], dtype=np.int64)
            rows, first, near, where = _block_matches(w, lists, slop)
            size = docs[-1][1] + docs[-1][2] + 1
            edges = np.zeros(size + 1, np.int64)
            np.add.at(edges, first, 1)
            np.add.at(edges, first + w.size[rows], -1)
            turns = np.flatnonzero(np.diff(np.cumsum(edges) > 0, prepend=False))
            spans: dict[int, list[dict]] = {}
            for begin, end in turns.reshape(-1, 2).tolist():
                doc = int(np.searchsorted(bases, begin, side="right")) - 1
                spans.setdefault(doc, []).append({"begin": begin - docs[doc][1], "end": end - docs[doc][1]})
            found, close = items(bases, rows, first), items(bases, near, where)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * len(docs), pa.int64()), pa.array(bases),
                 pa.array([d[0] for d in docs], pa.int64()), pa.array([d[2] for d in docs], pa.int64()),
                 pa.array([spans.get(i, []) for i in range(len(docs))], spans_type), pa.array([found.get(i, []) for i in range(len(docs))], pa.list_(pa.string())),
                 pa.array([close.get(i, []) for i in range(len(docs))], pa.list_(pa.string()))],
                names=["block", "base", "doc_id", "n_words", "spans", "items", "near_items"])

        block, docs, lists = None, [], {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "term", "doc_id", "base", "n", "positions"))):
                if row[0] != block:
                    if docs:
                        yield solve(block, docs, lists)
                    block, docs, lists = row[0], [], {}
                if row[1] is None:
                    docs.append(row[2:5])
                elif row[1] in number:
                    lists[number[row[1]]] = _unpack(row[5])
        if docs:
            yield solve(block, docs, lists)

    return run


def search(index: DataFrame, items: list[tuple[str, list[bytes]]], length: int = 10,
           slop: int | None = None) -> DataFrame:
    """Rows (block, base, doc_id, n_words, spans, items, near_items), one for each document of the index.

    ``items``: (id, words), PASS_WORDS words at most. ``spans`` has the runs of document words (end exclusive)
    inside any occurrence of a window of ``length`` consecutive item words (a shorter item is one window);
    ``items`` lists the items with such a window. ``near_items`` lists those of which all words of a window lie within ``slop`` words
    of its rarest one, in any order.
    """
    spark = index.sparkSession
    # One row for each test word at most, and those are bounded by PASS_WORDS.
    counts = index.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()
    windows = spark.sparkContext.broadcast(Windows(items, {r.term.encode(): r.n for r in counts}, length))
    ordered = (index.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block"))
    return ordered.mapInArrow(_search(windows, slop), (
        "block long, base long, doc_id long, n_words long, "
        "spans array<struct<begin:long,end:long>>, items array<string>, near_items array<string>"))


def _passes(benchmark: DataFrame, id_col: str, text_col: str):
    """Lists of (id, words) of PASS_WORDS words at most (or one item), read item by item."""
    batch, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        words = tokens((row.t or "").encode())
        if batch and held + len(words) > PASS_WORDS:
            yield batch
            batch, held = [], 0
        batch.append((row.i, words))
        held += len(words)
    yield batch


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  slop: int | None = None) -> DataFrame:
    """Rows (id_col, n_words, n_hit, n_items, items, near_items, spans, contaminated) for each row of ``docs``.

    A null text has no words. A null item id reads ``null``; items with equal ids count once; items without
    words have no window. Items are sorted as strings. Repeated documents give repeated rows. An empty
    benchmark contaminates nothing; an empty table gives no rows.
    """
    found = []
    for items in _passes(benchmark, item_id, item_text):
        index = build_index(docs, {w for _, words in items for w in words}, id_col, text_col)
        found.append(search(index, items, length, slop))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    if len(found) > 1:  # blocks are cut alike in every pass, so a document has the same place in each
        lists = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)
        out = (out.groupBy("block", "base", "doc_id", "n_words").agg(lists("spans"), lists("items"), lists("near_items"))
               .withColumns({c: F.array_distinct(c) for c in ("items", "near_items")}))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("reach")), lambda a, s: F.struct(
        (a["words"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["reach"]))).alias("words"),
        F.greatest(a["reach"], s["end"]).alias("reach")))["words"]
    return out.select(F.col("doc_id").alias(id_col), "n_words", covered.alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"), "items", "near_items", "spans",
                      (F.size("spans") > 0).alias("contaminated"))

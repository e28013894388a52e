"""Sets of word shingles, sketches of them, and the exact check of candidate groups.

Searches for near duplicates hand over spanning forests of candidate pairs. The whole sets of each group of candidates are then
brought together once, large groups in tiles of blocks, and compared in the task; what leaves it names for each linked text one
that it is linked with, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.llm.common import LOWER, byte_rows, shuffle_partitions
from arborlake.llm.components import components
from arborlake.runtime import materialize

#: Shingles of a block of a group; two blocks are in memory at once. A short text counts as LEAST shingles.
WEIGHT, LEAST = 1 << 20, 64
#: Words of 64 bits in the bitmap that narrows a scan of texts.
BITMAP_WORDS = 1 << 18
#: Texts compared in one matrix product, and shingles in it.
ROWS, COLUMNS = 512, 4096


def shingles(text: bytes | None, words: int = 5):
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, one without words has none."""
    import numpy as np
    import xxhash

    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    each = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    # A text of fewer words than a shingle is no shingle of another text.
    out = np.full(n, 0 if k == words else k, np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ each[i:i + n]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def set_key(hashes) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    import xxhash

    both = xxhash.xxh3_128_intdigest(hashes.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(both >> 64), signed(both & (1 << 64) - 1)


def spread(rows, near: Callable, most: int = 256):
    """Candidate groups of ``rows`` (arrays of equal length) as pairs (x, y) of a spanning forest.

    ``near(a, b)`` says for rows a and b (index arrays) which pairs are near. Groups grow by breadth: what is in a
    group is compared only with what is in none yet.
    """
    import numpy as np

    left, pairs = np.arange(rows), []
    while len(left) > 1:
        todo, left = left[:1], left[1:]
        while len(todo) and len(left):
            now, todo = todo[:most], todo[most:]
            found = near(now, left)
            hit = found.any(axis=0)
            if hit.any():
                pairs.append(np.stack([now[found[:, hit].argmax(axis=0)], left[hit]]))
                todo, left = np.concatenate([todo, left[hit]]), left[~hit]
    return np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)


def text_keys(ids: Column, text: Column) -> tuple[Column, Column]:
    """Two longs, 128 bits, that stand for an id and a text; never null."""
    return F.xxhash64(ids, text), F.xxhash64(F.lit("text"), text, ids)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key1, key2, text) of all rows."""
    ids, text = F.col(id_col).cast("long"), F.col(text_col)
    key1, key2 = text_keys(ids, text)
    return docs.select(ids.alias("id"), key1.alias("key1"), key2.alias("key2"), text.alias("text"))


class _Tile:
    """Rows of one tile (node and the columns of a test): their forest of candidates, and that of visitors with them."""

    def __init__(self, parts, near):
        import numpy as np

        self.near = near
        self.node, *self.cols = (np.concatenate(c) for c in zip(*parts))
        self.pairs = spread(len(self.node), near(*self.cols))
        self.group = np.arange(len(self.node))
        for x, y in self.pairs.T.tolist():  # pairs lead from the inside of a group outwards
            self.group[y] = self.group[x]

    def forest(self):
        return self.node[self.pairs[0]], self.node[self.pairs[1]]

    def visit(self, node, *cols):
        """For each visitor one near row of each group of the tile."""
        import numpy as np

        m = len(self.node)
        near = self.near(*(np.concatenate(c) for c in zip(self.cols, cols)))
        for at in range(0, len(node), 256):
            who = np.arange(at, min(at + 256, len(node)))
            i, j = np.nonzero(near(m + who, np.arange(m)))
            one = np.unique(i * m + self.group[j], return_index=True)[1]
            yield node[who[i[one]]], self.node[j[one]]


def tile_forests(near: Callable, key: str, columns: list[str]):
    """Candidate pairs (a, b) of tiles, for rows in the order of ``key``, ``tile`` and ``visitor``, visitors last.

    ``near``, given the arrays of ``columns``, makes the test for ``spread``. Of each tile a spanning forest is
    returned, and for each visitor one row of each group of the tile that it is near to.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        now, parts, tile = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in ("node", *columns)]
            place = [np.asarray(batch.column(c)) for c in (key, "tile", "visitor")]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in place], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                turn, visitor = (place[0][a], place[1][a]) != now, place[2][a]
                if parts and (visitor or turn):
                    tile, parts = _Tile(parts, near), []
                    yield pairs(*tile.forest())
                if turn:
                    now, tile = (place[0][a], place[1][a]), None
                part = [c[a:b] for c in cols]
                if not visitor:
                    parts.append(part)
                elif tile is not None:
                    for found in tile.visit(*part):
                        yield pairs(*found)
        if parts:
            yield pairs(*_Tile(parts, near).forest())

    return run


def shared(a, b):
    """Numbers of common elements of each set of ``a`` with each of ``b`` (lists of sorted distinct arrays)."""
    import numpy as np

    sets = [*a, *b]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    # Elements of one set alone have no part in any intersection.
    some = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column = owner[some], number[column[some]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[i:j], column[i:j] - at] = 1
        out += (held[:len(a)] @ held[len(a):].T).astype(np.int64)
    return out


class Forest:
    """Groups of numbers 0 .. n - 1, joined by links that are found in blocks."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b, linked):
        """Joins rows ``a`` with those of ``b`` for which the matrix ``linked`` is true, a few at a time."""
        import numpy as np

        while True:
            x = np.array([self.root(i) for i in a.tolist()])
            y = np.array([self.root(i) for i in b.tolist()])
            linked = linked & (x[:, None] != y[None, :])
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                return
            for i, j in zip(a[some].tolist(), b[linked[some].argmax(axis=1)].tolist()):
                i, j = self.root(i), self.root(j)
                self.parent[max(i, j)] = min(i, j)


def linked_groups(sets, share: tuple[int, int], blocks=None):
    """Least row of each row's group: sets are linked if they share ``share`` of their elements.

    With ``blocks`` (a number for each set) of two values only sets of different blocks are compared.
    """
    import numpy as np

    up, down = share
    size = np.array([len(s) for s in sets], np.int64)
    groups = Forest(len(sets))
    if blocks is None or len(set(blocks)) == 1:
        order = np.argsort(size, kind="stable")
        sides = [(order[i:i + ROWS], order[j:j + ROWS]) for i in range(0, len(order), ROWS) for j in range(i, len(order), ROWS)]
    else:
        blocks = np.asarray(blocks)
        one, two = (at[np.argsort(size[at], kind="stable")] for at in (np.flatnonzero(blocks == b) for b in sorted(set(blocks.tolist()))))
        sides = [(one[i:i + ROWS], two[j:j + ROWS]) for i in range(0, len(one), ROWS) for j in range(0, len(two), ROWS)]
    for a, b in sides:
        if size[a[-1]] * down < size[b[0]] * up or size[b[-1]] * down < size[a[0]] * up:
            continue
        both = size[a][:, None] + size[b][None, :]
        groups.join(a, b, shared([sets[i] for i in a], [sets[i] for i in b]) * (up + down) >= up * both)
    return np.array([groups.root(i) for i in range(len(sets))])


def _compared(share: tuple[int, int]):
    """Pairs (a, b) of a node and the first of its group, for one tile after another."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, nodes, sets, blocks = None, [], [], []

        def close():
            first = linked_groups(sets, share, blocks)
            node = np.array(nodes, np.int64)
            some = np.flatnonzero(first != np.arange(len(first)))
            out = pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[first[some]])], names=["a", "b"])
            nodes.clear(), sets.clear(), blocks.clear()
            return out

        for batch in batches:
            group, one, two, block, node = (np.asarray(batch.column(c)) for c in ("component", "one", "two", "block", "node"))
            held = batch.column("held")
            for i in range(batch.num_rows):
                now = (group[i], one[i], two[i])
                if now != key:
                    if nodes:
                        yield close()
                    key = now
                if not nodes or nodes[-1] != node[i]:  # rows that repeat a text and its id come in a row
                    nodes.append(int(node[i]))
                    sets.append(np.asarray(held[i].values).view(np.uint64))
                    blocks.append(int(block[i]))
        if nodes:
            yield close()

    return run


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` (a long) may be in ``wanted``: a bitmap of fixed size leaves most others out before the exchange.

    The bitmap has BITMAP_WORDS words at most, whatever the input; on inputs so large that it fills up nothing is left out.
    """
    word = lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1).cast("long"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    bits = wanted.groupBy(word(F.col(key)).alias("_word")).agg(F.bit_or(bit(F.col(key))).alias("_bits"))
    bits = F.broadcast(materialize(bits, "bitmap"))
    here = rows.join(bits, word(rows[key]) == F.col("_word"))
    return here.filter(F.col("_bits").bitwiseAND(bit(F.col(key))) != 0).drop("_word", "_bits")


def confirmed(candidates: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) of nodes, enough for their components, that whole sets confirm.

    ``candidates``: forests of pairs (a, b). ``nodes``: rows (node, key1, key2) that name the text of a node. ``texts``:
    rows (key1, key2, text). Each text of a group of candidates is fetched once. A group is split in blocks by the
    number of its shingles, and each pair of blocks is compared in a tile of its own.
    """
    spark = candidates.sparkSession
    groups = components(candidates, "a", "b")
    wanted = materialize(nodes.join(groups, "node").select("key1", "key2", "node", "component"), "wanted")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(text, words).view(np.int64) for (text,) in byte_rows([part], "text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("component"), part.column("node"), pa.array([max(LEAST, len(s)) for s in sets], pa.int64()),
                     pa.array(sets, pa.list_(pa.int64()))], names=["component", "node", "weight", "held"])

    found = likely(texts, wanted, "key1").join(wanted, ["key1", "key2"]).select("component", "node", "text")
    sets = materialize(found.mapInArrow(run, "component long, node long, weight long, held array<long>"), "sets")
    sizes = sets.groupBy("component").agg(F.ceil(F.sum("weight") / WEIGHT).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiled = (sets.join(sizes, "component").withColumn("block", block)
             .withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("block", "beside").alias("one"), F.greatest("block", "beside").alias("two"), "block", "node", "held"))
    n = 4 * shuffle_partitions(spark)
    return (tiled.repartition(n, "component", "one", "two").sortWithinPartitions("component", "one", "two", "node")
            .mapInArrow(_compared(share), "a long, b long"))

"""Quality classifier by co-training: one view sees what a text says, the other what is known about the page.

Both start from a bounded sample of labelled rows. In each round each view scores a bounded pool of unlabelled
rows and hands those that it is surest about, with its labels, to the other view. Each view's output is then
calibrated on labelled rows that were kept apart, and the two are combined. All rows are scored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Labelled rows to fit on, unlabelled rows to exchange labels about (those whose ids have the least hashes), rounds,
#: and the share of the pool that a view hands over in a round.
LABELLED, POOL, ROUNDS, SHARE = 8_000, 8_000, 5, 0.04
WORD_BUCKETS, SOURCE_BUCKETS = 256, 32

_SIGNS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"%*#$&@^~", b"|\\/_+=", b"<>{}[]()", b"\"'`-"]


def text_view(data: bytes):
    """What a text says: shares of kinds of characters, repetition, word lengths, and hashed words."""
    import numpy as np

    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    distinct = set(words)
    out = [1 - len(data.translate(None, s)) / size for s in _SIGNS]
    out += [len(distinct) / n, sum(map(bytes.__eq__, words, words[1:])) / n, math.log1p(sum(map(len, words)) / n),
            sum(map(len, distinct)) / max(1, len(distinct)) / 10]
    kinds = np.bincount(np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in distinct), np.int64, len(distinct)), minlength=WORD_BUCKETS)
    return np.concatenate([out, 4 * kinds / math.sqrt(max(1, len(distinct)))]).astype(np.float32)


def page_view(data: bytes, lang: str | None, source: str | None):
    """What is known about a page: language, source, length and layout of its lines."""
    import numpy as np

    lines = data.split(b"\n")
    lengths = [len(x) for x in lines]
    size = max(1, len(data))
    out = [math.log1p(len(data)), math.log1p(len(lines)), math.log1p(size / len(lines)), math.log1p(max(lengths)),
           sum(n < 40 for n in lengths) / len(lines), len(zlib.compress(data, 1)) / size]
    hashed = np.zeros(2 * SOURCE_BUCKETS, np.float32)
    for at, value in ((0, lang), (SOURCE_BUCKETS, source)):
        hashed[at + zlib.crc32((value or "").encode()) % SOURCE_BUCKETS] = 1
    return np.concatenate([np.array(out, np.float32), hashed])


def _logistic(x, y, weight, rounds: int = 200, shrink: float = 1e-3):
    """Weights (the last is the bias) of a logistic regression by full-batch Adam steps."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) / weight.sum() + shrink * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


@dataclass
class View:
    """A linear model of standardised features."""

    mean: object
    scale: object
    weights: object = None

    def logit(self, x):
        import numpy as np

        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)

    def fit(self, x, y):
        import numpy as np

        # Both labels weigh alike.
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
        self.weights = _logistic(((x - self.mean) / self.scale).astype(np.float32), y, weight)


@dataclass
class Model:
    """Two views, the calibration (slope, offset) of each, and the weights that combine them; or one share for all."""

    views: tuple[View, View] | None
    calibration: tuple = ()
    combined: object = None
    share: float = 0.0

    def scores(self, text, page) -> tuple:
        """(combined, text view, page view), each from 0 to 1."""
        import numpy as np

        if self.views is None:
            return (np.full(len(text), self.share),) * 3
        squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        own = [a * v.logit(x) + b for v, x, (a, b) in zip(self.views, (text, page), self.calibration)]
        return squash(self.combined[0] * own[0] + self.combined[1] * own[1] + self.combined[2]), squash(own[0]), squash(own[1])


def cotrain(text, page, y, pool_text, pool_page, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Fits both views on arrays of features and labels; every fifth labelled row is kept for calibration."""
    import numpy as np

    if not len(y) or y.min() == y.max():
        return Model(None, share=float(y.mean()) if len(y) else 0.0)
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        kept[:] = False
    x, pools = (text, page), (pool_text, pool_page)
    views = [View(a.mean(axis=0), a.std(axis=0) + 1e-3) for a in x]
    own_x, own_y = [[a[~kept]] for a in x], [[y[~kept]], [y[~kept]]]
    free = np.ones(len(pool_text), bool)
    prior = y[~kept].mean()
    for turn in range(rounds + 1):
        for v, a, b in zip(views, own_x, own_y):
            v.fit(np.concatenate(a), np.concatenate(b))
        if turn == rounds or not free.any():
            break
        for this, other in ((0, 1), (1, 0)):
            at = np.flatnonzero(free)
            z = views[this].logit(pools[this][at])
            order = np.argsort(z, kind="stable")
            n = max(1, int(share * len(pool_text)))
            ones, zeros = max(1, round(n * prior)), max(1, round(n * (1 - prior)))
            picked = [(at[order[:zeros]], 0.0), (at[order[::-1][:ones]], 1.0)]
            for rows, label in picked:
                rows = rows[(views[this].logit(pools[this][rows]) > 0) == bool(label)]  # sure of this label only
                own_x[other].append(pools[other][rows])
                own_y[other].append(np.full(len(rows), label))
                free[rows] = False
    held = kept if kept.any() else ~kept
    logits = [v.logit(a[held]) for v, a in zip(views, x)]
    even = np.ones(held.sum())
    calibration = tuple(tuple(_logistic(z[:, None], y[held], even, 400)) for z in logits)
    pair = np.stack([a * z + b for z, (a, b) in zip(logits, calibration)], axis=1)
    return Model(tuple(views), calibration, _logistic(pair, y[held], even, 400))


def _views(batch):
    """Feature arrays of both views of an Arrow batch with text, lang and source."""
    import numpy as np

    rows = list(zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))))
    data = [((t or "").encode("utf-8", "surrogatepass"), g, s) for t, g, s in rows]
    return (np.stack([text_view(d) for d, _, _ in data]), np.stack([page_view(*d) for d in data])) if data else (None, None)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Fits on LABELLED rows of ``labels`` (doc_id, 0 or 1) and POOL rows of ``docs`` (doc_id, text, lang, source) without label.

    Ids labelled more than once count with their largest label; null ids and labels don't count. Without labels of
    both kinds every row has the share of ones as its score, 0 if there are none.
    """
    import numpy as np

    order = F.xxhash64("doc_id")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    some = known.orderBy(order, "doc_id").limit(LABELLED)
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    pool = (ids.join(labels.select("doc_id"), "doc_id", "left_anti").orderBy(order, "doc_id").limit(POOL)
            .withColumn("label", F.lit(-1)))
    # LABELLED + POOL rows of two numbers at most.
    texts = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(some.union(pool)), "doc_id")

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text, page = _views(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in text], pa.binary()),
                     pa.array([r.tobytes() for r in page], pa.binary())], names=["doc_id", "label", "t", "p"])

    rows = texts.mapInArrow(extract, "doc_id long, label int, t binary, p binary").toArrow().sort_by([("doc_id", "ascending"), ("t", "ascending")])
    label = rows.column("label").to_numpy()
    stack = lambda c, width: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float32).reshape(-1, width)
    text, page = stack("t", len(text_view(b""))), stack("p", len(page_view(b"", None, None)))
    told = label >= 0
    return cotrain(text[told], page[told], (label[told] > 0).astype(float), text[~told], page[~told])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, text_score, page_score), one for each row of ``docs`` (doc_id, text, lang, source).

    Null and empty texts have no words and one empty line; a null language or source is the empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = shared.value.scores(*_views(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(s, pa.float64()) for s in scores]],
                                                 names=["doc_id", "score", "text_score", "page_score"])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, T.StructType([
        docs.schema["doc_id"], *[T.StructField(c, T.DoubleType()) for c in ("score", "text_score", "page_score")]]))


def predicted(column: str = "score") -> Column:
    return (F.col(column) >= 0.5).cast("int")

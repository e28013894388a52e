"""Toxicity: a noisy-channel decoder restores disguised words, a linear model scores the restored text.

Character four-grams of all texts give a language model. A token with digits or signs among its letters, with
stretched or with spaced-out letters is a lattice of what each character and separator may stand for; Viterbi search finds the
reading with the least sum of channel cost and language-model cost. Features of the restored words are chosen and
weighted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from arborlake.llm.common import shuffle_partitions
from arborlake.runtime import materialize

#: Labelled rows (those whose ids have the least hashes) that the model is fitted on, and features it keeps.
SAMPLE_ROWS, FEATURES = 10_000, 4096
#: Tokens whose features a worker remembers.
CACHE_TOKENS = 500_000

# Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Costs of the channel, in nats: a sign read as a letter, as itself, or left out; a stretch read as one or two letters.
AS_LETTER, AS_ITSELF, LEFT_OUT, ONE, TWO = 1.0, 6.0, 4.0, 0.5, 1.5
#: Marks of a separator in a lattice (no token has them, they are white space): between single letters, between other
#: pieces of a token, between other tokens; with the costs of leaving it out and of a word break.
LETTERS, PIECES, TOKENS = "\x1e", "\x1d", "\x1f"
SPACING = {LETTERS: (0.0, 2.0), PIECES: (0.5, 0.5), TOKENS: (4.0, 0.0)}
#: Characters of a piece or token that may be part of a spaced-out word.
SHORT = 3

#: Nats by which a feature has to differ from chance to be proof by itself.
CERTAIN = 16.0
SYMBOLS = 32
_EDGE = re.compile(r"^[^\w@$!|]+|[^\w]+$")
_JUNK_EDGE = re.compile(r"^([^\w])\1{2,}|([^\w])\2{2,}$")
_SEPARATORS = re.compile(r"[^\w@$!|+(€£¡]+|_+")
_STRETCH = re.compile(r"([^\W\d_])\1\1+")


def symbol_table():
    """Symbol of each byte: 0 for white space, a to z, digits, other ASCII, and three kinds of UTF-8 bytes."""
    import numpy as np

    table = np.full(256, 28, np.int32)
    for b in range(256):
        if b in b" \t\n\r\x0b\x0c":
            table[b] = 0
        elif chr(b).isascii() and chr(b).isalpha():
            table[b] = ord(chr(b).lower()) - 96
        elif 48 <= b <= 57:
            table[b] = 27
        elif b >= 0x80:
            table[b] = 29 if b < 0xC0 else 30 if b < 0xE0 else 31
    return table


def language_model(docs: DataFrame, text_col: str = "text"):
    """Costs (nats) of each symbol after three others, from the four-grams of all texts; 32 ** 4 numbers.

    Each task adds up the four-grams of its texts and hands on one row for each that occurs, so what is
    exchanged grows with the number of tasks, and the result is bounded by the alphabet.
    """
    import numpy as np

    def count(batches):
        import pyarrow as pa

        table, total = symbol_table(), np.zeros(SYMBOLS**4, np.int64)
        edge = np.zeros(1, np.int32)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                data = text.as_py() or b""
                for at in range(0, len(data), 1 << 20):
                    s = np.concatenate([edge, table[np.frombuffer(data[max(0, at - 3):at + (1 << 20)], np.uint8)], edge])
                    if len(s) > 3:
                        grams, n = np.unique(((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:], return_counts=True)
                        total[grams] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = (docs.select(text_col).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(SYMBOLS**4)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(-1, SYMBOLS)
    base = (counts.sum(axis=0) + 1) / (counts.sum() + SYMBOLS)
    return -np.log((counts + 2 * base) / (counts.sum(axis=1, keepdims=True) + 2)).astype(np.float32).ravel()


def _symbols(text: str) -> list[int]:
    return [_TABLE[b] for b in text.encode()]


_TABLE = symbol_table().tolist()


def decode(token: str, costs) -> str:
    """The likeliest reading of a disguised lower-case token; the marks of ``SPACING`` are left out or become a space."""
    paths = {(0, 0, 0): (0.0, None)}
    at = 0
    while at < len(token):
        c, run = token[at], 1
        while at + run < len(token) and token[at + run] == c:
            run += 1
        at += run
        if c in SPACING:
            out, word = SPACING[c]
            options = [("", out), (" ", word)]
        elif c.isalpha():
            options = [(c * run, 0.0)] if run < 3 else [(c, ONE), (c * 2, TWO)]
        elif c in LEET:
            each = [(x, AS_LETTER) for x in LEET[c]]
            options = [(x * n, cost * n) for x, cost in each for n in {1, min(run, 2)}]
            options += [(c * run, AS_ITSELF), ("", LEFT_OUT)]
        else:
            options = [(c * run, AS_ITSELF), ("", LEFT_OUT)]
        after: dict[tuple, tuple] = {}
        for state, (cost, read) in paths.items():
            for text, channel in options:
                s, total = state, cost + channel
                for x in _symbols(text):
                    total += float(costs[((s[0] * SYMBOLS + s[1]) * SYMBOLS + s[2]) * SYMBOLS + x])
                    s = (s[1], s[2], x)
                if s not in after or total < after[s][0]:
                    after[s] = (total, (read, text))
        paths = after
    _, read = min(((cost + float(costs[((s[0] * SYMBOLS + s[1]) * SYMBOLS + s[2]) * SYMBOLS]), read)
                   for s, (cost, read) in paths.items()), key=lambda end: end[0])
    texts = []
    while read:
        read, text = read
        texts.append(text)
    return "".join(reversed(texts))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text) if w]


def _laced(pieces: list[str], other: str) -> str:
    """Pieces with the marks of the separators between them."""
    out = pieces[:1]
    for last, piece in zip(pieces, pieces[1:]):
        out += [LETTERS if len(last) == len(piece) == 1 else other, piece]
    return "".join(out)


def restore(token: str, costs) -> list[str]:
    """Words that a lower-case token without white space, or a run of tokens by ``spaced``, stands for.

    Short pieces of a token are read as they are and also by the lattice of what their separators may be.
    """
    if token.isalpha() and not _STRETCH.search(token):
        return [token]
    if LETTERS in token or TOKENS in token:
        return _words(decode(token, costs))
    token = _EDGE.sub("", _JUNK_EDGE.sub("", token)) or token
    parts = [p for p in _SEPARATORS.split(token) if p]
    words = []
    if len(parts) > 1 and max(map(len, parts)) <= SHORT and sum(map(len, parts)) > SHORT and not "".join(parts).isdigit():
        words = _words(decode(_laced(parts, PIECES), costs))
        if all(len(p) == 1 for p in parts):
            return words
    for part in parts:
        if part.isalpha() and not _STRETCH.search(part):
            words.append(part)
        elif any(c.isalpha() for c in part):
            words += _words(decode(part, costs))
        elif not part.isdigit():
            words.append(part)
    return words


def spaced(tokens: list[str]) -> list[str]:
    """Runs of tokens that may be spaced-out words, with marks between them.

    A run has three tokens of one character or more; single short tokens may stand between them or at its ends.
    """
    out, run = [], []

    def close():
        if len(run) > 2:
            first, last = run[0], run[-1] + 1
            first -= first > 0 and len(tokens[first - 1]) <= SHORT
            last += last < len(tokens) and len(tokens[last]) <= SHORT
            out.append(_laced(tokens[first:last], TOKENS))

    for i in [i for i, t in enumerate(tokens) if len(t) == 1]:
        if run and (i > run[-1] + 2 or i == run[-1] + 2 and len(tokens[i - 1]) > SHORT):
            close()
            run = []
        run.append(i)
    close()
    return out


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


def words_of(text: str | None, costs) -> set[str]:
    """Restored words of a text."""
    tokens = (text or "").lower().split()
    return {w for t in {*tokens, *spaced(tokens)} for w in restore(t, costs)}


@dataclass
class Model:
    """Weights of features of restored words; ``costs`` is the language model."""

    costs: object
    weights: dict[str, float]
    bias: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def of(self, token: str) -> tuple[str, ...]:
        """Weighted features of a token, remembered."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= CACHE_TOKENS:
                self.known.clear()
            found = tuple(f for w in restore(token, self.costs) for f in features(w) if f in self.weights)
            self.known[token] = found
        return found

    def present(self, text: str | None) -> set[str]:
        tokens = (text or "").lower().split()
        out: set[str] = set()
        for t in {*tokens, *spaced(tokens)}:
            out.update(self.of(t))
        return out

    def score(self, text: str | None) -> float:
        import math

        z = self.bias + sum(self.weights[f] for f in sorted(self.present(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _regression(rows: list[tuple[list[int], int]], size: int, rounds: int = 400, rate: float = 0.5, shrink: float = 1e-5):
    """Logistic regression on sparse binary rows by full-batch Adam steps."""
    import numpy as np

    y = np.array([label for _, label in rows], dtype=float)
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.array([x for f, _ in rows for x in f], dtype=np.int64)
    w, b = np.zeros(size), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(rows)), -30, 30)))
        gap = (p - y) / len(rows)
        g = np.append(np.bincount(col, gap[row], size) + shrink * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w.tolist(), float(b)


def _distinct(texts: DataFrame) -> DataFrame:
    """Of near copies in a sample one each, as the rare words of many copies would pass for proof.

    Copies share the least hash of their long words with a chance near to their likeness. Of three such hashes
    two agree for nearly all near copies and hardly ever for other texts.
    """
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= 7)
    hashed = lambda k: F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(k)))), F.xxhash64("text", F.lit(k)))
    for pair in ((0, 1), (0, 2), (1, 2)):
        least = F.xxhash64(*map(hashed, pair))
        texts = texts.groupBy("label", least.alias("least")).agg(F.min(F.struct("id", "text")).alias("row")).select("row.id", "label", "row.text")
    return texts


def _proof(one: int, zero: int, prior: float) -> float | None:
    """Share of ones among texts with a feature, if that alone shows a text to be toxic beyond chance.

    A disguised text may have one such word where those of the sample have many. The bound is Chernoff's.
    """
    import math

    n, q = one + zero, one / (one + zero)
    share = (one + prior) / (n + 1)
    spread = sum(a * math.log(a / b) for a, b in ((q, prior), (1 - q, 1 - prior)) if a)
    return share if q > prior and share >= 0.75 and n * spread > CERTAIN else None


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Fits on SAMPLE_ROWS rows of ``labels`` (id, 0 or 1) and the texts of ``docs``; the language model on all texts.

    Ids labelled more than once count with their largest label, null labels don't count. Without labels of both
    kinds every text has the share of ones among the labels as its score, 0 if there are none.
    """
    import math

    spark = docs.sparkSession
    costs = language_model(docs, text_col)
    sample = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
              .agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS))
    # The sample has SAMPLE_ROWS rows of two numbers at most.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    texts = materialize(texts.select("id", "label", "text"), "labelled")
    # Copies teach the weights, but only different texts are proof.
    single = materialize(_distinct(texts).select("id").distinct(), "distinct").withColumn("single", F.lit(True))
    texts = texts.join(single, "id", "left").withColumn("single", F.coalesce("single", F.lit(False)))
    texts = materialize(texts.repartition(shuffle_partitions(spark)), "sample")
    shared = spark.sparkContext.broadcast(costs)

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                seen[int(label > 0)].update({f for w in words_of(text, shared.value) for f in features(w)})
        for label, counts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([label] * len(counts), pa.int32()),
                                              pa.array(list(counts.values()), pa.int64())], names=["feature", "label", "n"])

    ones, every = texts.agg(F.sum((F.col("label") > 0).cast("int")), F.count("*")).first()
    if not ones or ones == every:
        share = (ones or 0) / every if every else 0.0
        return Model(costs, {}, math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -1e9)
    zeros = every - ones
    odds = F.abs(F.log((F.col("one") + 0.5) / (ones + 1)) - F.log((F.col("zero") + 0.5) / (zeros + 1)))
    chosen = (texts.mapInArrow(count, "feature string, label int, n long").groupBy("feature")
              .agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("one"),
                   F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("zero"))
              .filter(F.col("one") + F.col("zero") >= 3)
              .withColumn("gain", odds * F.sqrt(F.col("one") + F.col("zero")))
              .filter(odds > 1.5).orderBy(F.desc("gain"), "feature").limit(FEATURES))
    names = sorted(r.feature for r in chosen.select("feature").collect())
    number = {f: i for i, f in enumerate(names)}
    probe = spark.sparkContext.broadcast(Model(costs, dict.fromkeys(names, 0.0), 0.0))

    def reduce(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [sorted(number[f] for f in probe.value.present(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), batch.column("single"), pa.array(rows, pa.list_(pa.int32()))],
                                             names=["id", "label", "single", "present"])

    rows = texts.mapInArrow(reduce, "id string, label int, single boolean, present array<int>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["present"]))
    weights, bias = _regression([(r["present"], int(r["label"] > 0)) for r in rows], len(names))
    alone = [r for r in rows if r["single"]]
    prior = sum(r["label"] > 0 for r in alone) / max(1, len(alone))
    counts = [[0, 0] for _ in names]
    for r in alone:
        for i in r["present"]:
            counts[i][r["label"] <= 0] += 1
    for i, (one, zero) in enumerate(counts):
        if one and 0 < prior < 1 and (share := _proof(one, zero, prior)) is not None:
            weights[i] = max(weights[i], math.log(share / (1 - share)) - bias)
    return Model(costs, dict(zip(names, weights)), bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text (0 to 1); null and empty texts have no words.

    A column named ``score_col`` is replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(score_col)
    fields = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])
    place = kept.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, score_col])

    return kept.mapInArrow(run, fields)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``labels`` that may be learned from; the others are held out."""
    return labels.filter(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 5 == 0

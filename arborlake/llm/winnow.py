"""Winnowing fingerprints in DataFrame functions, and a document beside the one that follows it.

Hashes roll over every K consecutive words; of every W consecutive hashes the least is kept, the rightmost of equal
ones, with its position. Two texts that share W + K - 1 words in a row therefore share a kept hash, whatever
surrounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborlake.llm.common import range_bucket, range_spans, shuffle_partitions

#: Words of a gram and grams of a window.
K, WINDOW = 5, 8
#: Characters of a range of ids; a range is sorted by one task.
RANGE_CHARS = 8 << 20
_POSITIONS = (1 << 31) - 1


def with_fingerprint(df: DataFrame, text: Column, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``out``, the kept grams of a text in order of position.

    A gram is one long: its 32-bit hash, then the largest position less its own, so that the least long is the
    least hash and of equal hashes the rightmost. A text of fewer than ``k`` words is one gram, of fewer grams than
    a window one window; a null text or one without words has none. A text may have 2 ** 31 words.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    count = F.size("_w") - (k - 1)
    gram = lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(k)])
    packed = lambda i: (F.shiftleft(gram(i).bitwiseAND(F.lit(0xFFFFFFFF)), 31)
                        .bitwiseOR(F.lit(_POSITIONS).cast("long") - i))
    numbers = F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)
    none = F.array().cast("array<long>")
    df = df.withColumn("_g", F.when(F.size("_w") > 0, F.transform(numbers, packed)).otherwise(none)).drop("_w")
    least = lambda i: F.least(*[F.get("_g", i + j) for j in range(window)])  # noqa: E731  nulls beyond the end don't count
    starts = F.sequence(F.lit(0), F.greatest(F.size("_g") - window, F.lit(0)))
    kept = F.when(F.size("_g") > 0, F.array_distinct(F.transform(starts, least))).otherwise(none)
    return df.withColumn(out, kept).drop("_g")


def hashes(kept: Column) -> Column:
    return F.transform(kept, lambda x: F.shiftright(x, 31))


def positions(kept: Column) -> Column:
    return F.transform(kept, lambda x: F.lit(_POSITIONS).cast("long") - x.bitwiseAND(F.lit(_POSITIONS).cast("long")))


def as_text(kept: Column) -> Column:
    """Eight hexadecimal digits for each kept hash, in order of position."""
    return F.array_join(F.transform(kept, lambda x: F.lower(F.lpad(F.hex(F.shiftright(x, 31)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct hashes of two fingerprints that both have (Dice); 1 for two empty ones."""
    a, b = F.array_distinct(hashes(a)), F.array_distinct(hashes(b))
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, next_text, fingerprint and the range and order columns) for a second look at neighbours.

    Documents follow each other by descending id, nulls last, equal ids by the hash of their text; after the last
    comes the first. Ids are cut in even ranges, each sorted by one task; the first row of a range also goes, as a
    ghost, to the end of the range before it, so no text moves more than once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    spans = range_spans(rows, "doc_id", max(1, size // RANGE_CHARS, min(shuffle_partitions(docs.sparkSession), size >> 18)))
    n, lows, highs = max(1, len(spans)), [a for a, _ in spans], [b for _, b in spans]
    own = range_bucket(F.col("doc_id"), lows)
    first = F.coalesce(F.get(F.array(*map(F.lit, highs)), own) == F.col("doc_id"), F.lit(False)) if spans else F.lit(True)
    at = lambda range_, ghost: F.struct(range_.cast("int").alias("range"), F.lit(ghost).alias("ghost"))
    places = F.when(first, F.array(at(own, 0), at(F.pmod(own + 1, F.lit(n)), 1))).otherwise(F.array(at(own, 0)))
    return (rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.explode(places).alias("at"))
            .select("doc_id", "text", "tie", "at.range", "at.ghost"))


def beside_next(docs: DataFrame, **columns) -> DataFrame:
    """Rows (doc_id, n_chars, edited, kept, edited_kept, next_kept), one for each row of ``docs``.

    ``edited`` is the text whose last third of code points (rounded down) gives way to as many (or all) of the next
    document's first. Null texts are empty; repeated rows follow each other; a single row is its own next.
    """
    order = W.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), "tie")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    placed = neighbours(docs, **columns).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    placed = placed.select("doc_id", "tie", "range", "ghost", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    placed = with_fingerprint(placed, F.col("text"), "kept").drop("text")
    placed = placed.withColumn("next_kept", F.lead("kept").over(order)).filter("ghost = 0").drop("tie", "range", "ghost")
    return with_fingerprint(placed, F.col("edited"), "edited_kept")

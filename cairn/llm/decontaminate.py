"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only.

A window (13 words of an item, or the whole of a shorter item) is contained in a document exactly when it equals
one of its word runs. Its words are ordered by how often they occur in the corpus; the rarest one is its necessary
prefix, so documents meet a window only where they hold that word. The word's place in the window bounds where the
window can start and whether it fits; what is left is compared word for word.

Texts are cut into words once, into a table in the shared folder. A place that holds a prefix word takes along only
the words that a window over it can reach, so what is joined does not grow with the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import without, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after A-Z are folded.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The window table is broadcast up to so many rows of at most so many characters; beyond, Spark shuffles the join.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 32 * 1024 * 1024
#: Prefix words (16 bytes each) are broadcast up to so many; beyond, they are dealt to so many parts of each word's places.
BROADCAST_TOKENS, SPREAD = 1_000_000, 32
#: The most windows, and places in documents (about), that one part of a shuffled prefix word holds.
PART_WINDOWS, PART_PLACES = 4096, 1 << 20


def plain(text: Column) -> Column:
    """The words of a text with A-Z folded, one blank between them; none: the empty text."""
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.trim(F.regexp_replace(folded, BETWEEN, " ")), F.lit(""))


def words_of(plain_text: Column) -> Column:
    """The words of a plain() text."""
    return F.array_remove(F.split(plain_text, " "), "")


def _sized(frame: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(frame) if fits else frame


def windows_of(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct (item, window, n): ids as text, the window's words with one blank between, and their number."""
    words = items.select(F.col(item_col).cast("string").alias("item"), words_of(plain(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    span = F.least(F.lit(width), F.size("w"))
    runs = words.select("item", "w", span.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - span + 1)).alias("i"))
    return runs.select("item", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("window"), "n").distinct()


def _prefixes(words: DataFrame, windows: DataFrame, fits: bool) -> DataFrame:
    """Each window with its rarest word over all documents: window, n, seen, token (a hash), at (its place)."""
    spots = windows.select("window", "n", F.posexplode(F.split("window", " ")).alias("at", "word")).select("window", "n", "at", F.xxhash64("word").alias("token"))
    said = words.select(F.explode_outer(words_of(F.col("plain"))).alias("word")).select(F.xxhash64("word").alias("token"))
    seen = said.join(_sized(spots.select("token").distinct(), fits), "token").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "at")).alias("rarest")
    return spots.join(_sized(seen, fits), "token", "left").groupBy("window", "n").agg(rarest).select("window", "n", "rarest.*")


def _met(words: DataFrame, prefixes: DataFrame, width: int, fits: bool) -> DataFrame:
    """The places of documents that hold a window's prefix word, once for each such window."""
    places = words.select("id", "h", words_of(F.col("plain")).alias("w")).select("id", "h", "w", F.posexplode_outer("w").alias("pos", "word")).select("id", "h", "w", "pos", F.xxhash64("word").alias("token"))
    around = F.slice("w", F.greatest(F.lit(1), F.col("pos") + 2 - width), F.col("pos") - F.greatest(F.lit(0), F.col("pos") + 1 - width) + width).alias("around")
    if fits:
        return places.join(F.broadcast(prefixes), "token").select("id", "h", "pos", around, "window", "n", "at")
    # both sides of a prefix word are dealt to parts, so neither its windows nor its places all meet in one task
    tokens = prefixes.groupBy("token").agg(F.ceil(F.count("*") / PART_WINDOWS).alias("window_parts"), F.ceil((F.max("seen") + 1) / PART_PLACES).alias("place_parts"))
    tokens = written(tokens, "prefix-words")
    if tokens.count() <= BROADCAST_TOKENS:
        found = places.join(F.broadcast(tokens), "token")
    else:
        dealt = tokens.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        found = places.select("id", "h", "pos", "token", around, F.pmod("pos", F.lit(SPREAD)).alias("deal")).join(dealt, ["token", "deal"]).withColumnRenamed("around", "w")
        around = F.col("w").alias("around")
    place_part = F.pmod(F.xxhash64("id", "h", "pos"), F.col("place_parts"))
    found = found.select("id", "h", "pos", around, "token", place_part.alias("place_part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("window_parts") - 1)).alias("window_part"))
    window_part = F.pmod(F.xxhash64("window"), F.col("window_parts"))
    held = prefixes.join(tokens, "token").select("window", "n", "at", "token", window_part.alias("window_part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("place_parts") - 1)).alias("place_part"))
    return found.join(held, ["token", "window_part", "place_part"]).select("id", "h", "pos", "around", "window", "n", "at")


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated if n_hit > 0 and
    share * n_hit >= n_words. Null and empty texts have no words and are clean; very long texts are read whole;
    an item without words has no window; items with a null id hit words like all others and count as one item, which
    items_sha256 cannot name; repeated rows each get their own (equal) result; an empty table gives no rows; no
    items: all clean. Other columns are not read. with_hash adds text_hash, which tells texts under one id apart.
    """
    pairs = written(windows_of(items, item_col, item_text_col, width), "item-windows")
    windows = pairs.select("window", "n").distinct()
    rows, chars = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    fits = rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS
    text = F.col(text_col)
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), plain(text).alias("plain"))
    words = written(words.withColumn("n_words", F.size(words_of(F.col("plain"))).cast("long")), "words")
    prefixes = written(_prefixes(words, windows, fits), "window-prefixes")
    first = F.least(F.col("pos"), F.lit(width - 1)) - F.col("at")  # where the window starts among the words around
    met = _met(words, prefixes, width, fits).where((first >= 0) & (first + F.col("n") <= F.size("around")))
    met = met.where(F.array_join(F.slice("around", first + 1, F.col("n")), " ") == F.col("window"))
    hits = met.select("id", "h", (F.col("pos") - F.col("at")).alias("s"), "n", "window").distinct()
    # the words of a document's hits, each counted once: every hit adds what reaches beyond those that start before it
    spans = hits.groupBy("id", "h", "s").agg(F.max("n").alias("n")).groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("spans"))
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n_hit"))
    add = lambda at, x: F.struct(F.greatest(at["reach"], x["e"]).alias("reach"), (at["n_hit"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], at["reach"]))).alias("n_hit"))
    n_hit = spans.select("id", "h", F.aggregate("spans", start, add, lambda at: at["n_hit"]).alias("n_hit"))
    named = hits.select("id", "h", "window").distinct().join(_sized(pairs, fits and pairs.count() <= BROADCAST_ROWS), "window").select("id", "h", "item").distinct()
    named = named.groupBy("id", "h").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    found = n_hit.join(named.select(F.col("id").alias("i"), F.col("h").alias("k"), "n_items", "items"), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")))
    found = found.select(F.col("id").alias("f_id"), F.col("h").alias("f_h"), F.col("n_hit").alias("f_hit"), "n_items", "items")
    out = words.select("id", "h", "n_words").join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    n_hit = F.coalesce("f_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"),
        *([F.col("h").alias("text_hash")] if with_hash else []),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs that contamination() finds clean, with the columns of docs; nulls, empty and very long texts,
    repeats and empty tables as there, and all clean rows stay."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, with_hash=True, **options).where("contaminated")
    return without(docs, bad, {id_col: F.col(id_col), "text_hash": F.xxhash64(F.col(text_col))}, "contaminated")

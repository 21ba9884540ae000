"""Benchmark passages in documents: a prefix-filtered join of shingle sets, with exact containment of whole windows.

A window is a run of an item's words. A document holds it only if it holds all of the window's shingles, each at its
place. So with shingles ordered by rarity, a window's prefix is one token, its rarest shingle: documents are joined on that
alone. Where it stands gives the only place the window can begin; the place must lie inside the document
(positional and length bounds), and then every other shingle must stand where the window has it. As shingles overlap, two runs
that differ in a word differ in a shingle, and a wrong match needs equal 64-bit hashes at each such place.

All of it is DataFrame functions. The shingles of a document are made in its row; only those of the benchmark pass the first
join, whose small side the planner broadcasts if the written table is small enough. Rarity is counted over what passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.lineage import cut
from keyweave.llm.columns import ALNUM_WORD, column, fresh, let, lower_ascii, words_of

WINDOW_WORDS, SHINGLE_WORDS = 10, 4
TEXT_KEY = ["text_key_1", "text_key_2"]


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for the whole text: equal texts are looked at once, and their rows find the result by it."""
    return [F.xxhash64(text).alias(TEXT_KEY[0]), F.xxhash64(F.lit(7), text).alias(TEXT_KEY[1])]


def _item_words(text: Column) -> Column:
    return words_of(lower_ascii(F.coalesce(text, F.lit(""))), ALNUM_WORD)


def _shingles(words: Column, width: int) -> Column:
    """(at, shingle) for each run of `width` words."""

    def made(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - width)
        row = lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(w, i + 1, width)).alias("shingle"))
        return F.when(F.size(w) >= width, F.transform(starts, row)).otherwise(F.array().cast("array<struct<at: int, shingle: bigint>>"))

    return let(words, made)


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, n, words), and (window, item) for every item that has one."""
    words = items.select(column(item_id).alias("item"), _item_words(column(text)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.lit(window), F.size("words"))
    placed = words.select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("start"))
    runs = placed.select("item", "n", F.slice("words", F.col("start"), F.col("n")).alias("words")).distinct()
    numbered = cut(runs.select("n", "words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    held = cut(runs.join(numbered.select("words", "window"), "words").select("window", "item").distinct(), "window-items")
    return numbered, held


def find_windows(docs: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """All places (text key, start, n, window) at which a distinct text of `docs` (text) holds a window."""
    wide = windows.withColumn("width", F.least(F.lit(shingle), F.col("n")))
    widths = [r["width"] for r in wide.select("width").distinct().collect()]  # at most `shingle` numbers
    parts = cut(
        wide.select(
            "window", "n", "width", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("width") + 1), lambda i: F.xxhash64(F.slice("words", i, F.col("width")))))
        ).select("window", "n", "width", F.col("pos").alias("offset"), F.col("col").alias("shingle")),
        "window-shingles",
    )
    asked = cut(parts.select("shingle").distinct(), "asked-shingles")

    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*_text_key(text), _item_words(text).alias("words"))
    if not widths:
        made = F.array().cast("array<struct<at: int, shingle: bigint>>")
    else:
        made = F.concat(*[_shingles(F.col("words"), w) for w in sorted(widths)])
    shingled = split.select(*TEXT_KEY, F.size("words").alias("n_words"), made.alias("made"))
    placed = shingled.select(*TEXT_KEY, "n_words", F.inline_outer("made"))  # no filter on the array is inferred for this
    found = cut(placed.join(asked, "shingle", "left_semi").distinct(), "found-shingles")

    rarity = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    ranked = parts.join(rarity, "shingle", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    prefix = ranked.groupBy("window", "n", "width").agg(F.min(F.struct("times", "shingle", "offset")).alias("p"))
    prefix = cut(prefix.where("p.times > 0").select("window", "n", "width", "p.shingle", "p.offset"), "prefixes")

    start = F.col("at") - F.col("offset")
    candidates = found.join(prefix, "shingle").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    candidates = candidates.select(*TEXT_KEY, "window", "n", "width", start.alias("start"))
    expected = candidates.join(parts.select("window", "offset", "shingle"), "window").withColumn("at", F.col("start") + F.col("offset"))
    met = expected.join(found.select(*TEXT_KEY, "at", "shingle"), [*TEXT_KEY, "at", "shingle"])
    whole = met.groupBy(*TEXT_KEY, "start", "n", "width", "window").agg(F.count(F.lit(1)).alias("met"))
    return cut(whole.where(F.col("met") == F.col("n") - F.col("width") + 1).select(*TEXT_KEY, "start", "n", "window"), "found-windows")


def hits_by_text(places: DataFrame, window_items: DataFrame) -> DataFrame:
    """(text key, n_hit, items) for each text with a window; the items of a text are sorted as strings."""
    before = Window.partitionBy(*TEXT_KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = places.groupBy(*TEXT_KEY, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = spans.withColumn("new", covered).groupBy(*TEXT_KEY).agg(F.sum("new").alias("n_hit"))
    named = places.select(*TEXT_KEY, "window").distinct().join(window_items, "window").select(*TEXT_KEY, F.col("item").cast("string").alias("item")).distinct()
    items = named.groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return cut(n_hit.join(items, TEXT_KEY, "left"), "hits")


def find_benchmark(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """Add n_words, n_hit, items (ids as sorted strings) and contaminated to each row.

    A document word is hit if it lies in any occurrence of a window of `window` consecutive words of an item; an item of
    fewer words is one window, one without words has none. Nulls and empty texts have no words. An item with a null id
    has windows, which hit, but no name in `items`; items of equal id count as one. Repeated rows stay and are marked
    alike. Input columns named like an output are replaced.
    """
    windows, window_items = item_windows(benchmark, item_id, item_text, window)
    hits = hits_by_text(find_windows(df.select(column(text).cast("string").alias("text")), windows, shingle), window_items)
    whole = F.coalesce(column(text).cast("string"), F.lit(""))
    own = [c for c in df.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    keys = [fresh(df, k) for k in TEXT_KEY]
    named = hits.select(F.col(TEXT_KEY[0]).alias(keys[0]), F.col(TEXT_KEY[1]).alias(keys[1]), F.struct("n_hit", "items").alias(hit := fresh(df, "hit")))
    counted = F.size(words_of(whole, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    keyed = df.select(*[column(c) for c in own], counted.alias("n_words"), *[c.alias(k) for c, k in zip(_text_key(whole), keys, strict=True)])
    return keyed.join(named, keys, "left").select(
        *[column(c) for c in own],
        "n_words",
        F.coalesce(f"{hit}.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(f"{hit}.items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col(f"{hit}.n_hit") > 0, F.lit(False)).alias("contaminated"),
    )

"""Words that differ by one letter from a much more frequent word, found by permuterm rotations.

A word is marked with a terminator and rotated at each letter. Turned so that an edited letter comes last, all words that
differ in that letter alone share what stands before it, and a word without the letter is just that. So each word
writes, for every letter, the rotation that skips it, and, as a whole, each of its own rotations. Sorted, the rows of one
rotation are one group: a word for each letter that can stand there and at most one without, so no group is larger than
the alphabet. A row holds the rotation and the letter, from which the word itself is read again.

Words longer than LONG letters have rotations named by hashes, since their texts would grow with the square of the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.lineage import cut, cut_observed
from keyweave.llm.columns import column, lower_ascii

TERMINATOR = "\0"
LONG = 64  # letters; longer words have rotations with hashed names
_PRIME, _BASE = 2**61 - 1, 0x1B873593CC9E2D51 % (2**61 - 1)


@dataclass(frozen=True)
class VariantRule:
    #: A run of these characters that no other of them touches is a word's text.
    letters: str = "a-z\\u00C0-\\u00FF"
    least_letters: int = 6
    least_count: int = 5
    #: A form is at least so many times as frequent as its variant.
    ratio: int = 5
    #: A run loses a letter in a document if this number divides the checksum of both; 0: never.
    every: int = 0


def _without_letter(run: Column, at: Column) -> Column:
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))


def word_counts(df: DataFrame, id: str = "doc_id", text: str = "text", rule: VariantRule = VariantRule()) -> DataFrame:
    """(word, n): the words of all texts, A-Z in lower case, with enough letters and occurrences.

    With `rule.every`, the checksum of `<id>:<run>` decides which runs lose which letter, as planted misspellings. Null and
    empty texts have no words; a null id counts as an empty one; repeated rows count each time. No other column is read.
    """
    lowered = lower_ascii(column(text).cast("string"))
    run = F.col("run")
    # Letters only get fewer, so shorter runs can be passed over at once.
    runs = df.select(
        F.coalesce(column(id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"[{rule.letters}]{{{rule.least_letters},}}"), F.lit(0))).alias("run"),
    )
    if rule.every:
        mark = F.crc32(F.concat("id", F.lit(":"), run))
        at = (mark % F.char_length(run)).cast("int")
        runs = runs.select(F.when(mark % rule.every == 0, _without_letter(run, at)).otherwise(run).alias("run"))
    counted = runs.where(F.char_length(run) >= rule.least_letters).groupBy(run.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= rule.least_count)


def _rotations(words: DataFrame) -> DataFrame:
    """(rotation, letter, n): without each letter in turn, and whole, then with an empty letter."""
    word, size = F.col("word"), F.char_length("word")
    before = lambda i: F.substring(word, F.lit(1), i)
    after = lambda i: F.substring(word, i + 1, size)
    turned = lambda end, start: F.concat(end, F.lit(TERMINATOR), start)
    skipping = F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.struct(turned(after(i + 1), before(i)).alias("rotation"), F.substring(word, i + 1, F.lit(1)).alias("letter"))
    )
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(after(i), before(i)).alias("rotation"), F.lit("").alias("letter")))
    return words.select(F.explode(F.concat(skipping, whole)).alias("r"), "n").select("r.rotation", "r.letter", "n")


def _short_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n), each pair once each way, for words of at most LONG letters."""
    groups = _rotations(words).groupBy("rotation").agg(F.collect_list(F.struct("letter", "n")).alias("found"))
    groups = groups.where(F.size("found") > 1)  # of at most one row for each letter and one without
    start, end = F.substring_index("rotation", TERMINATOR, -1), F.substring_index("rotation", TERMINATOR, 1)
    placed = groups.select(start.alias("start"), end.alias("end"), "found", F.explode("found").alias("x"))
    pairs = placed.select("start", "end", "x", F.explode("found").alias("y")).where("x.letter <> y.letter")
    # One of equal letters in a row can go in as many places; the first of them counts.
    added = F.concat("x.letter", "y.letter")
    replaced = (F.col("x.letter") != "") & (F.col("y.letter") != "")
    once = pairs.where(replaced | ~F.endswith(F.col("start"), added))
    return once.select(F.concat("start", "x.letter", "end").alias("word"), F.concat("start", "y.letter", "end").alias("near"), F.col("y.n").alias("near_n"))


def _hashed_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rotation, name) of each word (name, word): hashes of its letters before and after each place, in O(1) each."""
    for batch in batches:
        for name, word in zip(batch.column(0), batch.column(1), strict=True):
            codes = list(map(ord, word.as_py()))
            n, heads, powers = len(codes), [0], [1]
            for c in codes:
                heads.append((heads[-1] * _BASE + c + 1) % _PRIME)
                powers.append(powers[-1] * _BASE % _PRIME)
            tail = lambda i: (heads[n] - heads[i] * powers[n - i]) % _PRIME  # noqa: B023, E731  of the letters from i on
            keys = [f"{i}:{n - i - 1}:{heads[i]:x}:{tail(i + 1):x}" for i in range(n)]
            keys += [f"{i}:{n - i}:{heads[i]:x}:{tail(i):x}" for i in range(n + 1)]
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([name.as_py()] * len(part))], ["rotation", "name"])


def _long_pairs(words: DataFrame) -> DataFrame:
    """As `_short_pairs`, for words of LONG letters and more; what hashes find is checked."""
    named = cut(words.select(F.sha2("word", 256).alias("name"), "word", "n"), "long-words")
    rows = named.select("name", "word").mapInArrow(_hashed_rotations, "rotation string, name string")
    groups = rows.groupBy("rotation").agg(F.collect_set("name").alias("found")).where(F.size("found") > 1)
    pairs = groups.select("found", F.explode("found").alias("a")).select("a", F.explode("found").alias("b")).where("a <> b").distinct()
    left, right = named.select(F.col("name").alias("a"), "word"), named.select(F.col("name").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of words (word, n) that differ by one inserted, deleted or replaced code point.

    `words` holds each word once. Null words, and words with the terminator in them, have no neighbours.
    """
    usable = words.where(~F.contains("word", F.lit(TERMINATOR)) & (F.char_length("word") > 0))
    size = F.char_length("word")
    short = _short_pairs(usable.where(size <= LONG))
    return short.union(_long_pairs(usable.where(size >= LONG))).distinct() if not usable.where(size > LONG).isEmpty() else short


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms (word, form) ends; each round doubles what has been followed.

    Forms lead to ever more frequent words, so chains end, and are as long as a logarithm of the counts.
    """
    now, seen = cut_observed(forms.select("word", F.col("form").alias("root")), "forms", moved=F.count(F.lit(1)))
    while seen["moved"]:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        now, seen = cut_observed(step, "forms", moved=F.count_if("moved"))
        now = now.select("word", "root")
    return now


def group_variants(words: DataFrame, rule: VariantRule = VariantRule()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of `words` (word, n), each given once.

    The form is the near word with the largest n (of several, the smallest in code-point order) if that is at least
    `rule.ratio` times the word's own, else null; the root ends the chain of forms. Without neighbours n_near is 0.
    """
    words = cut(words.select("word", "n"), "words")
    # The least of (-n, word) is the most frequent one and, of these, the first; it combines in the map tasks.
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.minus") >= rule.ratio * F.col("n")
    judged = cut(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")
        ),
        "variants",
    )
    roots = follow_forms(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(df: DataFrame, id: str = "doc_id", text: str = "text", rule: VariantRule = VariantRule()) -> DataFrame:
    """As `group_variants`, for the words of all texts of `df`; see `word_counts` for nulls, ids and repeated rows."""
    return group_variants(word_counts(df, id, text, rule), rule)

"""Quality rules: counts of a text's own repetition, and the distance of its histograms from those of its language.

Each text gives two histograms: characters by class, and words by the common words of its language. The reference of a
language is the mean histogram of all its texts that pass the plain rules and are long enough. A text is
dropped when the Jensen-Shannon distance of one of its histograms from the reference is above that histogram's limit;
texts shorter than a histogram's guard aren't judged by it, because few characters or words are always far off.

All of it is DataFrame functions. A text's words and windows stay inside its row, so nothing is shuffled
but one row of means for each language and task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.lineage import cut
from keyweave.llm.columns import SPACED_WORD, column, fresh, let, words_of

# Frequent function words of the languages.
COMMON_WORDS = {
    "en": "the of and to in is a that for it on with as be was by this are from at or an he which only".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur avec pas ne se plus ce il".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
# The character classes, in ASCII; white space and what is not ASCII are classes too, the rest is one more.
CLASSES = {
    "upper": "A-Z",
    "digit": "0-9",
    "symbol": r"#*$%&|<>",
    "punctuation": r"""!"'()+,\-./:;=?@\[\\\]^_`{}~""",
}
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    """The plain rules, and for each histogram the largest distance and the shortest text, in words, that it judges."""

    least_words: int = 20
    most_repeat_percent: int = 30
    character_distance: float = 0.33
    character_guard: int = 20
    word_distance: float = 0.28
    word_guard: int = 100


def repeated_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more among the words."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def twice(s: Column) -> Column:
            found = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(found, lambda x: x["at"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            let(placed, twice),
            start,
            lambda a, at: F.struct((at + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - at)).alias("n")),
            lambda a: a["n"],
        )

    hashed = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    counted = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n > WINDOW, counted).otherwise(0).cast("long")


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.regexp_replace(text, F.lit(f"[{characters}]+"), F.lit("")))


def measured(df: DataFrame, text: str, lang: str, out: str) -> DataFrame:
    """Add a struct of the counts and the two histograms."""
    whole = F.coalesce(column(text), F.lit(""))
    spaced = fresh(df, "words")
    split = df.withColumn(spaced, words_of(whole, SPACED_WORD))
    words = F.col(spaced)
    listed = F.lit(None).cast("array<string>")
    for code, common in COMMON_WORDS.items():
        listed = F.when(column(lang) == code, F.array(*map(F.lit, common))).otherwise(listed)
    every = sorted({w for common in COMMON_WORDS.values() for w in common})
    # One set lookup a word leaves the common words of any language; each word of the own list is then counted in those.
    held = F.filter(F.transform(words, F.lower), lambda w: w.isin(every))
    counts = let(
        held, lambda h: F.transform(listed, lambda w: (F.size(h) - F.size(F.array_remove(h, w))).cast("double"))
    )
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(SPACED_WORD))
    figures = split.withColumn(
        out,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(whole).cast("long").alias("chars"),
            _without(whole, r"\x20\x09-\x0D").cast("long").alias("word_chars"),
            *[_without(whole, f"^{members}").cast("long").alias(f"n_{name}s") for name, members in CLASSES.items()],
            _without(whole, r"\x00-\x7F").cast("long").alias("n_other"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.coalesce(counts, F.array().cast("array<double>")).alias("common"),
        ),
    ).drop(spaced)
    return figures


def _shares(measures: str) -> tuple[Column, Column]:
    of = lambda name: F.col(f"{measures}.{name}")
    kinds = [of(f"n_{name}s") for name in CLASSES] + [of("n_other"), of("chars") - of("word_chars")]
    rest = of("chars") - sum(kinds[1:], kinds[0])
    characters = F.array(*[k / F.greatest(of("chars"), F.lit(1)) for k in [*kinds, rest]])
    uncommon = of("n_words") - F.aggregate(of("common"), F.lit(0.0), lambda a, x: a + x)
    words = F.transform(F.concat(of("common"), F.array(uncommon)), lambda c: c / F.greatest(of("n_words"), F.lit(1)))
    return characters, words


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance of two histograms of equal length, 0 to 1: the root of the divergence in bits."""

    def side(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (side(a, (a + b) / 2) + side(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def _means(shares: Column, bins: int) -> Column:
    return F.array(*[F.avg(F.get(shares, F.lit(i))) for i in range(bins)])


def apply_quality_rules(
    df: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits(), keep_text: bool = True
) -> DataFrame:
    """Add the five counts, base_failed, the two distances and the verdict `kept` to each row.

    A null counts as an empty text: no words, base_failed, not kept. A language without a list of common words, or null,
    is judged by its characters only. Distances are null where no text of the language passes the plain rules and the
    guard; such rows follow the plain rules. Repeated rows are judged alike and all stay. Input columns named like
    an output are replaced. With `keep_text` false the text isn't written to the shared folder nor returned.
    """
    own = [c for c in df.columns if c not in {*MEASURES, "base_failed", "kept", "character_distance", "word_distance"}]
    m, key, other, ref_c, ref_w = (fresh(df, x) for x in ("measures", "language", "lang", "ref_characters", "ref_words"))
    kept_columns = [column(c) for c in own if keep_text or c != text]
    figures = cut(measured(df, text, lang, m).select(*kept_columns, column(lang).alias(key), m), "quality")
    characters, words = _shares(m)
    n, repeats = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    failed = (n < limits.least_words) | (100 * repeats > limits.most_repeat_percent * n)

    bins = max(map(len, COMMON_WORDS.values())) + 1
    long_enough = n >= max(limits.character_guard, limits.word_guard)
    means = figures.where(~failed & long_enough).groupBy(F.col(key).alias(other)).agg(
        _means(characters, len(CLASSES) + 3).alias(ref_c), _means(words, bins).alias(ref_w)
    )
    # One row for each language: written, so that the planner knows how small it is.
    references = cut(means.withColumn(ref_w, F.filter(ref_w, lambda x: x.isNotNull())), "language-references")
    joined = figures.join(references, F.col(key).eqNullSafe(F.col(other)), "left")
    far_characters = jensen_shannon(characters, F.col(ref_c))
    far_words = F.when(F.size(words) == F.size(ref_w), jensen_shannon(words, F.col(ref_w)))
    rejected = ((n >= limits.character_guard) & (far_characters > limits.character_distance)) | (
        (n >= limits.word_guard) & (far_words > limits.word_distance)
    )
    return joined.select(
        *[column(c) for c in own if keep_text or c != text],
        *[F.col(f"{m}.{name}").alias(name) for name in MEASURES],
        failed.alias("base_failed"),
        far_characters.alias("character_distance"),
        far_words.alias("word_distance"),
        (~failed & ~F.coalesce(rejected, F.lit(False))).alias("kept"),
    )

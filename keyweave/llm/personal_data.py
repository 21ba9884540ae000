"""Personal data: fixed patterns, and identifiers found by the contexts that those patterns turn up in.

Spans of the fixed patterns are seeds. The two words before a seed are a lexical pattern; what such a pattern extracts
elsewhere are instances, among them identifiers no fixed pattern knows. Patterns and instances form a graph. In each round,
until the scores have settled, a
pattern's confidence is the share of its occurrences that are instances, weighted by their scores, and an instance's score is
the best confidence of a pattern with enough different instances. Instances of high-confidence patterns so support further
patterns. In the end the patterns that hold mark their unseen identifiers.

All of it is DataFrame functions. Spans are found in a text's own row; the graph is aggregated in the map tasks first, so a
context or value that is everywhere is one row of a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.lineage import cut, cut_observed
from keyweave.llm.columns import column, fresh, let, words_of

# The kinds, in the order that spans of one start are listed, and the base patterns. Possessive repeats
# and starts at the edge of a run find what the plain patterns find, in linear time and without recursion.
KINDS = ["email", "ip", "card", "phone", "context"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_IP = r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.|$)){4}$"
_MARKS = r"[(\[{<\"'`#*_“”‘’‚„«»‹›]"  # before a word, not of it
#: Words also end after ':' and '=', so `no:X1` has the same words as `no: X1`.
_PART = r"[^\x20\x09-\x0D:=]++[:=]*+|[:=]++"
#: A word that may be an identifier: marks, then from its first letter or digit to its last, with five digits and more.
_IDENTIFIER = (
    rf"(?<![^\x20\x09-\x0D:=]){_MARKS}*+(?=[^\x20\x09-\x0D:=0-9]*+[0-9])[A-Za-z0-9](?:[A-Za-z0-9._/#-]*[A-Za-z0-9])?"
)
BLOCK = 256
CONTEXT_CHARS = 120
SETTLED = 1e-6  # the rounds end when all confidences together rise by less


@dataclass(frozen=True)
class Bootstrap:
    rounds: int | None = None  # at most; without it, until nothing changes
    least_instances: int = 3
    least_confidence: float = 0.5


def _prefix_ends(items: Column) -> Column:
    """For (gap, length) items, spans (start, end); in blocks, so that growing the array stays cheap for many items."""
    empty = F.array().cast("array<struct<start: int, end: int>>")

    def within(block: Column, at: Column) -> Column:
        step = lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end")))).alias("out"),
        )
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda a: a["out"])

    def all_blocks(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))
        length = lambda b: F.aggregate(b, F.lit(0), lambda n, y: n + y["gap"] + y["len"])
        starts = let(
            blocks,
            lambda bs: F.aggregate(
                bs,
                F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                lambda a, b: F.struct((a["at"] + length(b)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
                lambda a: a["out"],
            ),
        )
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: within(b, F.get(at, i)))))

    return F.when(F.size(items) > 0, let(items, all_blocks)).otherwise(empty)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, in code points: the pieces between matches give the places."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        items = let(gaps, lambda g: F.transform(found, lambda v, i: F.struct(F.char_length(F.get(g, i)).alias("gap"), F.char_length(v).alias("len"))))
        return F.zip_with(_prefix_ends(items), found, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))

    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    return let(values, lambda v: F.when(F.size(v) > 0, placed(v)).otherwise(none))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        digit = lambda i: F.substring(d, F.char_length(d) - i, F.lit(1)).cast("int")
        shown = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda n, i: n + shown(i))

    long_enough = lambda d: F.char_length(d).between(14, 19)
    return let(_digits(value), lambda d: F.when(long_enough(d), total(d) % 10 == 0).otherwise(False))


_HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(_IP),
    "card": _luhn,
    "phone": lambda v: F.char_length(_digits(v)).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """(start, rank, end, value) of the fixed patterns, sorted; rank is the place of the kind in KINDS."""
    none = F.array().cast("array<struct<start: int, rank: int, end: int, value: string>>")

    def of_kind(rank: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _HOLDS[kind](m["value"]))
        named = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(text.rlike("[0-9]" if kind != "email" else "@") & text.contains(_NEEDS[kind]), named).otherwise(none)

    kinds = [of_kind(rank, kind) for rank, kind in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*kinds))


def _identifiers(text: Column) -> Column:
    found = F.filter(matches(text, _IDENTIFIER), lambda m: F.char_length(_digits(m["value"])) >= 5)

    def unmarked(m: Column) -> Column:
        value = F.regexp_replace(m["value"], f"^{_MARKS}+", "")
        return F.struct((m["end"] - F.char_length(value)).alias("start"), m["end"].alias("end"), value.alias("value"))

    return F.when(text.rlike("[0-9]"), F.transform(found, unmarked)).otherwise(F.array().cast("array<struct<start: int, end: int, value: string>>"))


def _occurrence(text: Column, span: Column, seed: bool) -> Column:
    """A span with the pattern before it: a hash of the two words, null where there aren't two."""
    first = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    before = F.lower(F.substring(text, first + 1, span["start"] - first))
    unmarked = F.regexp_replace(before, rf"{_MARKS}++\z", "")
    words = words_of(unmarked, _PART)
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        F.lower(span["value"]).alias("value"),
        F.when(unmarked.rlike(r"[\x20\x09-\x0D:=]\z"), let(words, lambda w: F.when(F.size(w) > 1, F.xxhash64(F.slice(w, -2, 2))))).alias("pattern"),
        F.lit(seed).alias("seed"),
    )


def _spans_and_occurrences(df: DataFrame, text: Column) -> DataFrame:
    """Add `base` and `occurrences`: seeds, and possible identifiers that no base span touches."""
    with_base = df.withColumn("base", base_spans(text))
    apart = F.filter(_identifiers(text), lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    seeds = F.transform("base", lambda s: _occurrence(text, s, True))
    return with_base.withColumn("occurrences", F.concat(seeds, F.transform(apart, lambda s: _occurrence(text, s, False))))


def _totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern is followed by any word, in all texts."""
    words = words_of(F.lower("text"), _PART)
    hashes = let(
        words,
        lambda w: F.when(
            F.size(w) > 2, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.slice(w, i, 2)))
        ).otherwise(F.array().cast("array<bigint>")),
    )
    all_pairs = texts.select(F.explode_outer(hashes).alias("pattern"))  # no filter on the array is inferred for this
    return all_pairs.join(patterns, "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def confident_patterns(occurrences: DataFrame, texts: DataFrame, rule: Bootstrap) -> DataFrame | None:
    """The patterns (pattern, confidence) that hold after the rounds; None if none can."""
    seen = occurrences.where("pattern IS NOT NULL").groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = cut(seen, "pattern-instances")
    enough = cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= rule.least_instances).select("pattern"), "patterns")
    if enough.isEmpty():
        return None
    # No score is above one, and more texts only add to a pattern's total. So the texts with five digits, in which all
    # identifiers are, already rule most patterns out; the others are counted in all texts.
    most = edges.join(enough, "pattern").groupBy("pattern").agg(F.sum("n").alias("most"))
    partly = _totals(texts.where(F.char_length(_digits(F.col("text"))) >= 5), enough)
    open_ = most.join(partly, "pattern", "left").where(F.col("most") >= rule.least_confidence * F.coalesce("total", F.lit(0)))
    possible = cut(open_.select("pattern"), "possible-patterns")
    if possible.isEmpty():
        return None
    graph = cut(edges.join(_totals(texts, possible), "pattern"), "graph")
    scores = graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    # Scores only rise, towards limits. Patterns that stay the same for a round may still rise, and others with them.
    confident, before, n_rounds = None, None, 0
    while rule.rounds is None or n_rounds < rule.rounds:
        n_rounds += 1
        scored = graph.join(scores, "value")
        patterns = scored.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("total"), F.sum("n"))).alias("confidence"),
            F.count(F.when(F.col("score") > 0, 1)).alias("instances"),
        )
        holds = (F.col("confidence") >= rule.least_confidence) & (F.col("instances") >= rule.least_instances)
        figures = {"n": F.count(F.lit(1)), "sum": F.sum("confidence")}
        confident, seen = cut_observed(patterns.where(holds).select("pattern", "confidence"), "confident", **figures)
        now = (seen.get("n") or 0, seen.get("sum") or 0.0)
        if now[0] == 0 or (before and now[0] == before[0] and now[1] - before[1] < SETTLED):
            break
        before = now
        best = graph.join(confident, "pattern", "left").groupBy("value").agg(
            F.greatest(F.max(F.col("seed").cast("double")), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("score")
        )
        scores = cut(best, "scores")
    return confident


def find_personal_data(df: DataFrame, text: str = "text", spans: str = "personal_spans", rule: Bootstrap = Bootstrap(), keep_text: bool = True) -> DataFrame:
    """Add the spans (kind, start, end in code points, end exclusive) of personal data in each whole text.

    A null counts as an empty text and has no spans. Repeated rows stay and are marked alike, and copies weigh as often as
    they are there, in a pattern's instances as in its other words; a pattern needs instances that differ. Other columns
    are kept; one named like the output is replaced. With `keep_text` false the text isn't written nor returned.
    """
    own = [c for c in df.columns if c != spans and (keep_text or c != text)]
    whole, row, kept = fresh(df, "whole"), fresh(df, "row"), fresh(df, "kept")
    packed = df.select(
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(own)]).alias(kept) if own else F.lit(None).alias(kept),
        F.coalesce(column(text).cast("string"), F.lit("")).alias(whole),
    )
    found = _spans_and_occurrences(packed, F.col(whole)).drop(whole).withColumn(row, F.monotonically_increasing_id())
    found = cut(found, "personal")
    occurrences = found.select(row, F.inline("occurrences"))
    texts = packed.select(F.col(whole).alias("text"))
    confident = confident_patterns(occurrences, texts, rule)

    typed = "array<struct<start: int, rank: int, end: int>>"
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    if confident is None:
        every = found.withColumn("all", base)
    else:
        added = occurrences.where("NOT seed").join(confident, "pattern").groupBy(row).agg(
            F.collect_list(F.struct("start", F.lit(len(KINDS) - 1).alias("rank"), "end")).alias("added")  # of one text
        )
        every = found.join(added, row, "left").withColumn("all", F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(typed)))))
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform("all", lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    marked = every.select(kept, named.alias("spans"))
    return marked.select(*[F.col(f"{kept}.c{i}").alias(c) for i, c in enumerate(own)], F.col("spans").alias(spans))

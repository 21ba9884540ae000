"""Scores of texts by a log-bilinear model, trained with noise-contrastive estimation, beside a unigram base.

The vocabulary is open: the model predicts a word's class from the classes of the words before it, and the word follows from
its class by exact counts. The most frequent words are classes of their own; all others are classed by their last
characters. Words are counted over all training texts, so every figure but the matrices is exact.

1. Count: each task adds up its words, one shuffle adds up the tasks. The table of counts is written.
2. Train: each task takes one pass of minibatches over its texts from the same start; the models, a fixed number of
   parameters each, are averaged by tokens (one more shuffle, by parameter).
3. Score: each task makes the normalised log-probabilities of all classes for its distinct contexts, by matrix products
   over batches of contexts, and reads off those of the tokens. Logarithms of counts come from a table of fixed size for
   frequent words and from a join with the written counts for the others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.lineage import cut
from keyweave.llm.columns import column, spaced_words

END = b"\n"  # the token after the last word; no word can hold this character
HELD_COUNTS = 300_000  # distinct words that a task adds up before it passes them on
TOKENS_AT_ONCE = 600_000


@dataclass(frozen=True)
class ModelSize:
    """All sizes are fixed, so what is collected and sent to the tasks is bounded whatever the corpus."""

    own_classes: int = 768
    suffix_classes: int = 255
    suffix: int = 2
    listed_words: int = 65_536  # at most
    width: int = 16
    context: int = 2
    batch: int = 1024
    noise: int = 32
    rate: float = 0.15
    seed: int = 11


@dataclass
class Vocabulary:
    """Classes and counts of the listed words; sums of each class. The last class takes words of unlisted suffixes."""

    size: ModelSize
    tokens: int
    words: int
    listed: dict[bytes, tuple[int, float]]  # class, log10(count + 1)
    suffixes: dict[str, int]
    inside: np.ndarray  # log10 of what a word's count + 1 is divided by in its class; 0 for own classes
    own: np.ndarray  # whether the class is one word
    share: np.ndarray  # of all training tokens, by class

    def class_of(self, word: bytes) -> int:
        return self.suffixes.get(word.decode()[-self.size.suffix :], len(self.share) - 1)


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word, and the end, occurs in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(spaced_words(text.as_py()))
                counts[END] += 1
                if len(counts) > HELD_COUNTS:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    return cut(texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame, size: ModelSize) -> Vocabulary:
    """Collects the listed words and the sums of the suffix classes: numbers of rows that `size` fixes."""
    total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    # The words from a magnitude on, so many that they still fit; magnitudes are eighths of powers of two.
    magnitude = F.floor(F.log2("n") * 8)
    left, least = size.listed_words, None
    for r in counts.groupBy(magnitude.alias("m")).count().orderBy(F.desc("m")).collect():  # at most 512 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["m"]
    top = [] if least is None else counts.where(magnitude >= least).collect()
    if len(top) < size.own_classes:  # the next magnitude doesn't fit: own classes don't depend on it
        top = counts.orderBy(F.desc("n"), "word").limit(min(size.own_classes, size.listed_words)).collect()
    top.sort(key=lambda r: (-r["n"], r["word"].encode()))
    own = [r["word"] for r in top[: size.own_classes]]
    others = counts
    if own:
        last = top[len(own) - 1]
        others = counts.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))
    ends = F.expr(f"right(word, {size.suffix})")
    by_suffix = others.groupBy(ends.alias("suffix")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"))
    suffixes = by_suffix.orderBy(F.desc("tokens"), "suffix").limit(size.suffix_classes).collect()

    n = len(own) + len(suffixes) + 1
    tokens, words = np.zeros(n), np.ones(n)
    tokens[: len(own)] = [r["n"] for r in top[: len(own)]]
    tokens[len(own) : -1] = [r["tokens"] for r in suffixes]
    words[len(own) : -1] = [r["words"] for r in suffixes]
    tokens[-1] = (total["tokens"] or 0) - tokens[:-1].sum()
    words[-1] = total["words"] - words[:-1].sum()
    is_own = np.arange(n) < len(own)
    found = Vocabulary(
        size,
        total["tokens"] or 0,
        total["words"],
        {},
        {r["suffix"]: len(own) + i for i, r in enumerate(suffixes)},
        np.where(is_own, 0.0, np.log10(tokens + words + 1)),
        is_own,
        (tokens + 1) / (tokens + 1).sum(),
    )
    for i, r in enumerate(top):
        word = r["word"].encode()
        found.listed[word] = (i if i < len(own) else found.class_of(word), float(np.log10(r["n"] + 1)))
    return found


@dataclass
class LogBilinear:
    """The vector of a context is a sum of its classes' vectors, each times the matrix of its place."""

    seen: np.ndarray  # a row for each class as context; one more for places before the text
    places: np.ndarray  # a matrix for each place
    predicted: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, words: Vocabulary) -> LogBilinear:
        size, n = words.size, len(words.share)
        rng = np.random.RandomState(size.seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        places = np.stack([np.eye(size.width, dtype=np.float32)] * size.context)
        return cls(draw(n + 1, size.width), places, draw(n, size.width), np.log(words.share).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.seen, self.places, self.predicted, self.bias)])

    def filled(self, flat: np.ndarray) -> LogBilinear:
        parts, at = [], 0
        for x in (self.seen, self.places, self.predicted, self.bias):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*parts)

    def vectors(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.seen[contexts[:, j]] @ self.places[j] for j in range(len(self.places)))

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all classes once for each distinct context."""
        base = len(self.seen)
        keys = contexts @ (base ** np.arange(contexts.shape[1], dtype=np.int64))
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        vectors, norms = self.vectors(contexts[first]), np.empty(len(first))
        for i in range(0, len(first), 256):  # so many scores stay in the cache
            scores = vectors[i : i + 256] @ self.predicted.T
            scores += self.bias
            top = scores.max(axis=1)
            scores -= top[:, None]
            norms[i : i + 256] = top + np.log(np.exp(scores, out=scores).sum(axis=1))
        own = np.einsum("ij,ij->i", vectors[at], self.predicted[targets]) + self.bias[targets]
        return own.astype(np.float64) - norms[at]


@dataclass
class Trainer:
    """Noise-contrastive estimation: tell the tokens from noise drawn by their share; steps are scaled by past gradients."""

    model: LogBilinear
    words: Vocabulary
    rng: np.random.RandomState
    past: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.past = [np.full(x.shape, 1e-3, np.float32) for x in (self.model.seen, self.model.places, self.model.predicted, self.model.bias)]
        self.log_share = np.log(self.words.share * self.words.size.noise).astype(np.float32)

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        m, size = self.model, self.words.size
        seen = [m.seen[contexts[:, j]] for j in range(size.context)]
        vectors = sum(x @ m.places[j] for j, x in enumerate(seen))
        noise = self.rng.choice(len(self.words.share), size.noise, p=self.words.share)
        own = np.einsum("ij,ij->i", vectors, m.predicted[targets]) + m.bias[targets] - self.log_share[targets]
        other = vectors @ m.predicted[noise].T + (m.bias[noise] - self.log_share[noise])
        up = 1 / (1 + np.exp(np.clip(own, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(other, -30, 30)))
        for_vectors = up[:, None] * m.predicted[targets] + down @ m.predicted[noise]

        n, width = len(m.bias), size.width
        at = np.arange(width)
        predicted = _gathered(targets, up[:, None] * vectors, n, at)
        np.add.at(predicted, noise, down.T @ vectors)
        bias = np.bincount(targets, up, n) + np.bincount(noise, down.sum(axis=0), n)
        places = np.stack([x.T @ for_vectors for x in seen])
        into_seen = sum(_gathered(contexts[:, j], for_vectors @ m.places[j].T, n + 1, at) for j in range(size.context))
        for value, gradient, past in zip((m.seen, m.places, m.predicted, m.bias), (into_seen, places, predicted, bias), self.past, strict=True):
            gradient = (gradient / np.sqrt(len(targets))).astype(np.float32)
            past += gradient * gradient
            value += size.rate * gradient / np.sqrt(past) / np.sqrt(len(targets)) * 4


def _gathered(ids: np.ndarray, rows: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """The sums of the rows of each id."""
    places = (ids[:, None] * len(at) + at).ravel()
    return np.bincount(places, rows.ravel(), n * len(at)).reshape(n, len(at))


@dataclass
class Tokens:
    """Some documents as one run of tokens."""

    words: list[bytes]
    classes: np.ndarray
    logs: np.ndarray  # log10(count + 1) of listed words, 0 for the others
    contexts: np.ndarray
    lengths: np.ndarray  # tokens of each document, the end included


def _as_tokens(words: list[bytes], lengths: list[int], known: Vocabulary) -> Tokens:
    class_of, size, before = known.class_of, known.size, len(known.share)
    found = list(map(known.listed.get, words))
    classes = np.array([f[0] if f else class_of(w) for f, w in zip(found, words, strict=True)], np.int64)
    logs = np.array([f[1] if f else 0.0 for f in found])
    counts = np.array(lengths)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    contexts = np.full((len(words), size.context), before, np.int64)
    place = np.arange(len(words))
    for j in range(size.context):
        inside = place - j - 1 >= starts
        contexts[inside, j] = classes[place[inside] - j - 1]
    return Tokens(words, classes, logs, contexts, counts)


def _runs(texts: pa.Array, known: Vocabulary) -> Iterator[Tokens]:
    held, lengths = [], []
    for text in texts:
        words = spaced_words(text.as_py())
        held += words
        held.append(END)
        lengths.append(len(words) + 1)
        if len(held) >= TOKENS_AT_ONCE:
            yield _as_tokens(held, lengths, known)
            held, lengths = [], []
    if held:
        yield _as_tokens(held, lengths, known)


def train(texts: DataFrame, words: Vocabulary) -> LogBilinear:
    """The mean of the models of all tasks, by tokens."""
    start, spark = LogBilinear.start(words), texts.sparkSession
    if not words.tokens:
        return start
    sent = spark.sparkContext.broadcast(words)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        trainer = Trainer(LogBilinear.start(known), known, np.random.RandomState(known.size.seed))
        n = 0
        for batch in batches:
            for run in _runs(batch.column(0), known):
                order = trainer.rng.permutation(len(run.classes))
                for i in range(0, len(order), known.size.batch):
                    own = order[i : i + known.size.batch]
                    trainer.step(run.contexts[own], run.classes[own])
                n += len(order)
        if n:
            flat = trainer.model.flat().astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), n))], ["i", "value", "n"])

    fitted = texts.mapInArrow(fit, "i bigint, value double, n bigint")
    mean = fitted.groupBy("i").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()  # one row for each parameter
    flat = np.empty(start.flat().size)
    flat[mean.column("i").to_numpy()] = mean.column("value").to_numpy()
    return start.filled(flat)


def _scorer(sent, model, names: list[str]) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = sent.value, model.value
        for batch in batches:
            at = 0
            for run in _runs(batch.column(0), known):
                ends = np.cumsum(run.lengths)
                starts = ends - run.lengths
                in_class = np.where(known.own[run.classes], 0.0, run.logs) - known.inside[run.classes]
                logs = own.log_probabilities(run.contexts, run.classes) / np.log(10) + in_class
                unlisted = np.flatnonzero(run.logs == 0)
                places = unlisted.tolist()
                until = np.searchsorted(unlisted, ends)
                rare, times, offsets = [], [], [0]
                for i, j in zip([0, *until[:-1]], until, strict=True):
                    tail = Counter([run.words[p] for p in places[i:j]])
                    rare += tail
                    times += tail.values()
                    offsets.append(len(rare))
                listed = run.lengths - np.diff(until, prepend=0)
                rows = batch.slice(at, len(run.lengths))
                at += len(run.lengths)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[1:],
                        pa.array(run.lengths),
                        pa.array(listed, pa.int64()),
                        pa.array(np.add.reduceat(run.logs, starts)),
                        pa.array(np.add.reduceat(logs, starts)),
                        lists(pa.array(rare, pa.binary()).cast(pa.string())),
                        lists(pa.array(times, pa.int32())),
                    ],
                    names,
                )

    return score


def score_texts(df: DataFrame, id: str = "doc_id", text: str = "text", size: ModelSize = ModelSize()) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts whose crc32 of the id is 2 modulo 7 are held out of counts and training; a null id counts as an empty one. A
    null text is an empty text, whose only token is the end. Repeated rows are scored alike and count in training as
    often as they are there. Without training texts the model is its start and every word is new. Other columns
    aren't read, so their names don't matter.
    """
    docs = df.select(column(id).alias("id"), column(text).cast("string").alias("text"))
    texts = docs.where(~held_out(F.col("id"))).select("text")
    counts = count_words(texts)
    known = vocabulary(counts, size)
    model = train(texts, known)
    send = df.sparkSession.sparkContext.broadcast

    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", "n_listed", "listed_log", "model_log", "rare", "times"]
    schema = f"id {kind}, n_tokens bigint, n_listed bigint, listed_log double, model_log double, rare array<string>, times array<int>"
    scored = docs.select("text", "id").mapInArrow(_scorer(send(known), send(model), names), schema)
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")

    rare = scored.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    counted = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_row = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rare")
    )
    rare_log, n_rare = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    floor = float(np.log10(known.tokens + known.words + 1))
    return scored.drop("rare", "times").join(of_row, "row", "left").select(
        F.col("id").alias(id),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("n_listed") + n_rare).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("listed_log") + rare_log - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("model_log") + rare_log).alias("score"),
    )

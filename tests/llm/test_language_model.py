import math
import zlib
from collections import Counter

import numpy as np
import pytest

from keyweave.llm.language_model import LogBilinear, ModelSize, count_words, score_texts, vocabulary
from keyweave.llm.queries import op1_language_model


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def base(rows):
    counts = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    score = lambda t: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
    return n, [(len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), score(t)) for _, t in rows]


def same_base(found, rows):
    n, expected = base(rows)
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for (i, _), (n_tokens, n_known, score) in zip(rows, expected):
        r = by_id[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(i), n_tokens, n_known, n)
        assert r.base_score == pytest.approx(score, rel=1e-9, abs=1e-12)
        assert r.score < 0 and math.isfinite(r.score)


def test_held_out_texts_score_better_than_the_base(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = op1_language_model(spark, folder).collect()
    same_base(found, rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_texts(spark, texts):
    values = [None, "", "a B b\x0bc", "a B b c", "new" + "x" * 10_000, "é É " * 5000, "a"]
    df = texts(values, extra=["n_tokens", "row", "id"])
    found = score_texts(df).collect()
    same_base(found, list(enumerate(values)))


def test_small_lists_change_no_count(spark, texts):
    values = [f"w{i % 7} w{i % 3} common{i}" for i in range(60)]
    size = ModelSize(own_classes=2, suffix_classes=3, listed_words=4, width=4, batch=16)
    same_base(score_texts(texts(values), size=size).collect(), list(enumerate(values)))


def test_frequent_words_have_own_classes(texts):
    """Words ranked up to 768 are predicted as themselves, also where many are equally frequent."""
    values = [" ".join(f"w{j}" for j in range(800 - i)) for i in range(100)]
    known = vocabulary(count_words(texts(values).select("text")), ModelSize())
    assert known.own.sum() == 768 and known.own[known.listed[b"w700"][0]]
    few = vocabulary(count_words(texts(values).select("text")), ModelSize(listed_words=790))
    assert few.own.sum() == 768


def test_probabilities_are_normalised(spark, texts):
    """Over all words the training texts hold, and a new word of each class, the chances add up to one."""
    size = ModelSize(own_classes=3, suffix_classes=2, width=4)
    counts = count_words(texts(["aa ab ac ba bb ca", "aa aa ab zz", "aa cc"]).select("text"))
    known = vocabulary(counts, size)
    model = LogBilinear.start(known)
    context = np.full((len(known.share), 2), len(known.share))
    classes = np.exp(model.log_probabilities(context, np.arange(len(known.share))))
    assert classes.sum() == pytest.approx(1)
    by_class = Counter()
    for r in counts.collect():
        cls, log = known.listed[r.word.encode()]
        by_class[cls] += 1.0 if known.own[cls] else 10 ** (log - known.inside[cls])
    for cls in range(len(known.share)):
        new = 0 if known.own[cls] else 10 ** -known.inside[cls]
        assert by_class[cls] + new == pytest.approx(1)


def test_no_training_text(spark, texts):
    assert score_texts(texts([])).collect() == []
    held = next(i for i in range(100) if is_held(i))
    row = score_texts(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()[0]
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and math.isfinite(row.score)

import re

from keyweave.llm.decontamination import find_benchmark

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text, items):
    words, hit, names = WORDS.findall(lower(text)), set(), set()
    for name, item in items:
        own = WORDS.findall(lower(item))
        k = min(10, len(own))
        for window in {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == window:
                    hit.update(range(i, i + k))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def test_against_plain(spark, texts):
    items = [(10, ITEM), (9, "short one"), (8, None), (7, ""), (6, ITEM), (5, "a a a a a a a a a a a a"), (4, "É é x"), (3, "three word item")]
    values = [
        None,
        "",
        ITEM,
        "so " + ITEM.upper() + " end",
        ITEM.replace("zeta", "zet"),
        "beta gamma delta epsilon zeta eta theta iota kappa lambda",
        "gamma delta epsilon zeta eta theta iota kappa lambda mu " * 2,
        "it is a Short, one; short one",
        "a " * 40,
        "É é x and é é x",
        "three word items three word item",
        "filler " * 50_000 + ITEM,
        "filler " * 50_000 + ITEM,
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = {r.doc_id: r for r in find_benchmark(texts(values, extra=["n_hit", "items", "window", "_hit"]), bench).collect()}
    assert len(rows) == len(values)
    for i, value in enumerate(values):
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == plain(value, items), i
        assert rows[i].contaminated == (rows[i].n_hit > 0) and rows[i].window == rows[i]._hit == "own"


def test_empty_tables(spark, texts):
    none = spark.createDataFrame([], "item_id bigint, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert [r.contaminated for r in find_benchmark(texts([ITEM]), none).collect()] == [False]
    assert find_benchmark(texts([]), bench).collect() == []

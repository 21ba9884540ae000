import re

from keyweave.llm.personal_data import Bootstrap, find_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), r, k, m.end()) for r, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(k, m[0])]
    return [(k, s, e) for s, _, k, e in sorted(found)]


VALUES = [
    None,
    "",
    "nothing",
    "mail a.b+c@x.org, a@b.c_d@e.f a@b..c@d.e @x.y a@b",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.0.0.01 1.2.3",
    "4111 1111-1111 1111 4111111111111112 4111111111111111 12",
    "+1 (555) 010-9999. +12 +1234567890123456 +44 20 7946 0958 and +1 555 0109 999x",
    "é漢😀 10.0.0.1 😀 +1 (555) 010-9999",
    "1" * 20_000 + " 4111111111111111",
    "10.0.0.1 " * 700,
    "a" * 20_000 + "@x.y",
]


def test_base_kinds(texts):
    df = find_personal_data(texts(VALUES, extra=["base", "row", "c0"]))
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(VALUES)
    for i, value in enumerate(VALUES):
        assert [tuple(s) for s in rows[i].personal_spans if s.kind != "context"] == plain(value), i
        assert (rows[i].text, rows[i].base, rows[i].row, rows[i].c0) == (value, "own", "own", "own")


def test_contexts_find_unseen_identifiers(texts):
    seeds = [f"please call number +1 (555) 010-{1000 + i} today" for i in range(12)]
    hidden = ["you may call number 7725-11-90431 as well", "page 7725-11-90431 of it", "year of 1234567 things"]
    rows = {r.doc_id: r.personal_spans for r in find_personal_data(texts(seeds + hidden)).collect()}
    assert [tuple(s) for s in rows[12]] == [("context", 20, 33)]
    assert rows[13] == rows[14] == []


def test_contexts_of_ordinary_words_find_nothing(texts):
    seeds = [f"in the +1 (555) 010-{1000 + i} day" for i in range(5)]
    ordinary = [f"in the word{i} and in the house" for i in range(20)]
    rows = {r.doc_id: r.personal_spans for r in find_personal_data(texts([*seeds, *ordinary, "in the 1234567 night"])).collect()}
    assert rows[25] == []


def test_rounds_reach_further_patterns(texts):
    first = [f"call my number +1 (555) 010-{1000 + i} now" for i in range(8)]
    second = [f"call my number 90{i}-55-1234{i} now" for i in range(4)]
    third = [f"badge id is 90{i}-55-1234{i} here" for i in range(4)]
    found = {r.doc_id: r.personal_spans for r in find_personal_data(texts([*first, *second, *third, "badge id is 7777-31 ok"])).collect()}
    assert all(found[i] for i in range(8, 17))
    once = {r.doc_id: r.personal_spans for r in find_personal_data(texts([*first, *second, *third]), rule=Bootstrap(rounds=1)).collect()}
    assert not once[12]


def test_marked_and_joined_identifiers(texts):
    seeds = [f"my account number +1 (555) 010-{1000 + i} here" for i in range(12)] + [f"my account no: +1 (555) 010-{1000 + i} here" for i in range(12)]
    hidden = ["account number (AB-1234567) x", 'account number "1234567"', "account number #1234567", "account no:X1234567", "account no: X1234568", "page (1234567)"]
    rows = {r.doc_id: r.personal_spans for r in find_personal_data(texts(seeds + hidden)).collect()}
    found = [[(s.kind, text[s.start : s.end]) for s in rows[len(seeds) + i]] for i, text in enumerate(hidden)]
    assert found == [[("context", v)] for v in ("AB-1234567", "1234567", "1234567", "X1234567", "X1234568")] + [[]]


def test_rounds_go_on_until_nothing_changes(texts):
    known, rows = [f"+1 (555) 010-{1000 + i}" for i in range(4)], []
    for hop in range(6):
        new = [f"9{hop}{i}-55-1234{i}" for i in range(4)]
        rows += [f"see my name{'x' * hop} code {v} here" for v in known * 2 + new]
        known = new
    found = {r.doc_id: r.personal_spans for r in find_personal_data(texts(rows)).collect()}
    assert all(found.values())
    few = {r.doc_id: r.personal_spans for r in find_personal_data(texts(rows), rule=Bootstrap(rounds=3)).collect()}
    assert not few[len(rows) - 1]


def test_empty_table(texts):
    assert find_personal_data(texts([])).collect() == []

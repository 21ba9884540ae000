import math
import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from keyweave.llm.secrets import EntropyRule, SecretFinder, find_secrets, highest_entropy, mask_secrets

KEY = "aB3dE5fG7hJ9kL1mN2pQ4rS6"
TEXTS = [
    None,
    "",
    "no secret here",
    'password: "hunter22" and Token=abcdef, api_key = short',
    "AKIA" + "A1" * 9 + " AKIA" + "B" * 10,
    "0123456789abcdef" * 2 + " 0123456789abcdef",
    f"see {KEY} there",
    "/usr/share/some/long/path/with/words",
    "123e4567-e89b-12d3-a456-426614174000",
    "é" * 30 + " secret=" + "z" * 10,
    "ſecret=abcdefgh",
]


def plain(text):
    """The base kinds as their definitions have them."""
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def test_base_kinds(texts):
    rows = {r.doc_id: r.secret_spans for r in find_secrets(texts(TEXTS, extra=["kind", "secret_spans"])).collect()}
    for i, text in enumerate(TEXTS):
        assert [tuple(s) for s in rows[i] if s.kind != "entropy"] == plain(text)
    assert [tuple(s) for s in rows[6]] == [("entropy", 4, 4 + len(KEY))]
    assert rows[7] == rows[8] == []


@given(st.text("abcABC01", max_size=60), st.integers(1, 25))
def test_window_entropy(run, window):
    def entropy(part):
        return -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())

    parts = [run[i : i + window] for i in range(max(1, len(run) - window + 1))] if run else []
    expected = max((entropy(p) for p in parts), default=0.0)
    assert abs(highest_entropy(run, window) - expected) < 1e-9


def test_allowed_runs_are_let_go():
    finder = SecretFinder(EntropyRule())
    assert finder.is_secret(KEY)
    assert not finder.is_secret("VeryLongIdentifierInWords")
    assert not finder.is_secret("some-words-and-2024-numbers")


def test_keys_after_equals_and_in_paths():
    finder = SecretFinder(EntropyRule())
    aws = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY"
    shown = lambda text: [(s["kind"], text[s["start"] : s["end"]]) for s in finder.spans(text)]
    assert shown(f"AWS_KEY={aws}") == shown(f"key={aws}") == shown(f"https://h/x?sig={aws}&b=1") == [("entropy", aws)]
    assert shown(f"x == {aws}=") == [("entropy", aws + "=")] and shown(f"x=={aws}===") == [("entropy", aws)]
    for text in (f"https://h/a_b/v1/{KEY}", f"https://h/a_b/{KEY}/x", f"a_b/{KEY}/c_d/e+f/{aws}"):
        masked = "".join(found for _, found in shown(text))
        assert KEY in masked and (aws in masked) == (aws in text)
    assert shown("MY_LONG_SETTING_A1B2C3D4=x") == shown("id=123e4567-e89b-12d3-a456-426614174000") == []


def test_masked(texts):
    rows = {r.doc_id: r.text for r in mask_secrets(texts(TEXTS)).collect()}
    assert rows[0] is None
    assert rows[3] == '[SECRET]" and [SECRET], api_key = short'
    assert rows[6] == "see [SECRET] there"
    assert rows[2] == TEXTS[2]


def test_long_text_and_empty_table(texts):
    text = ("word " * 200_000) + KEY
    row = find_secrets(texts([text])).collect()[0]
    assert [s.start for s in row.secret_spans] == [1_000_000]
    assert find_secrets(texts([])).collect() == []


def test_the_parts_of_a_url_are_judged_alone():
    finder = SecretFinder(EntropyRule())
    assert finder.spans("see https://example.com/path/ArticleTitle2021WithLongName/page12345 now") == []
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY"
    text = f"https://h.example/a_b/v1/{key}/x and {key}"
    assert [text[s["start"] : s["end"]] for s in finder.spans(text)] == [key, key]

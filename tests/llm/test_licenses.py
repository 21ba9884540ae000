import re

from keyweave.llm.license_scan import PHRASES, TEMPLATES, LicenseScanner, TokenAutomaton, scan_licenses
from keyweave.llm.queries import op4_license_scan


def test_automaton():
    a = TokenAutomaton("one [[two [[three]]]] {{1,2}} four")
    accepts = lambda text: a.longest(text.encode().split(), 0)
    assert accepts("one x four") == 3
    assert accepts("one two x four") == 4
    assert accepts("one two three x y four") == 6
    assert accepts("one four") == 0
    assert accepts("one two three x y z four") == 0
    assert accepts("one x five") == 0


def test_every_template_accepts_its_mandatory_wording():
    scanner = LicenseScanner(PHRASES, TEMPLATES)
    for name, template in TEMPLATES.items():
        text = re.sub(r"\{\{(\d+),\d+\}\}", lambda m: "word " * int(m[1]), template).replace("[[", "").replace("]]", "")
        assert name in [n["template"] for n in scanner.scan(text).notices], name


def test_wording_must_match():
    scanner = LicenseScanner(PHRASES, TEMPLATES)
    assert [n["template"] for n in scanner.scan("Released under the MIT License.").notices] == ["mit-notice"]
    assert scanner.scan("Released below the MIT License.").notices == []


def names(text):
    return [n["template"] for n in LicenseScanner(PHRASES, TEMPLATES).scan(text).notices]


def test_names_headers_and_versions():
    assert set(names("mozilla public license version 2 0 bsd 3-clause lgpl")) == {"mpl", "bsd-3-clause", "lgpl-name"}
    assert names("GNU Lesser General Public License v2.1") == ["lgpl"]
    assert names("SPDX-License-Identifier: GPL-2.0-or-later") == ["spdx"]
    header = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    assert set(names(header)) == {"mpl-2.0-header", "mpl"}
    assert names(header.replace("subject to", "under")) == ["mpl"]
    assert "cc-notice" in names("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")
    assert names("artistic freedom, a license of sorts, general public, mozilla") == []


def test_a_notice_takes_its_version_and_no_more():
    scan = LicenseScanner(PHRASES, TEMPLATES).scan
    for text, words in [("licensed under CC BY", 4), ("licensed under CC BY 4.0", 6), ("licensed under cc by and other words", 4)]:
        assert [(n["template"], n["words"]) for n in scan(text).notices] == [("cc-by-notice", words)]


def test_covered_words_count_once():
    found = LicenseScanner(PHRASES, TEMPLATES).scan("x distributed under the Boost Software License, Version 1.0 y")
    assert [n["template"] for n in found.notices] == ["bsl-1.0-notice", "bsl-1.0"]
    assert (found.covered, found.n_words) == (9, 11)
    assert LicenseScanner(PHRASES, TEMPLATES).scan(None).covered == 0


def test_many_starts(texts):
    scanner = LicenseScanner(PHRASES, TEMPLATES)
    assert scanner.scan("this is licensed " * 100_000 + "mozilla public license").covered == 3


def test_rows(texts):
    values = [None, "", "The MIT License, the mit license; CC BY 4.0", "mit\nlicense", "x " * 100_000 + "Apache License"]
    rows = {r.doc_id: r for r in scan_licenses(texts(values, extra=["license", "phrases"])).collect()}
    assert rows[0].license.n_words == rows[1].license.n_words == 0
    assert sorted((p.template, p.first) for p in rows[2].license.phrases) == [("cc-by", 6), ("mit", 1), ("mit", 4)]
    assert [p.first for p in rows[3].license.phrases] == [0]
    assert [p.first for p in rows[4].license.phrases] == [100_000]
    assert rows[2].phrases == "own"
    assert scan_licenses(texts([])).collect() == []


def test_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op4_license_scan(spark, folder).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[r.doc_id]))
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1

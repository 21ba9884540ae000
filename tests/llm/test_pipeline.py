import re

import sentencepiece

import corpus_pipeline
from keyweave.llm.queries import op2_quality_rules, tokenizer_file
from keyweave.llm.secrets import EntropyRule, SecretFinder
from test_decontamination import plain as hits
from test_ngram_join import plain as groups


def test_against_a_plain_version(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    good = {r.doc_id for r in op2_quality_rules(spark, folder).collect() if r.kept}
    ids = sorted(good)
    ids = [i for i, (_, root) in zip(ids, groups([docs[i].text for i in ids])) if ids[root] == i]
    ids = [i for i in ids if not hits(docs[i].text, items)[1]]
    finder, pieces = SecretFinder(EntropyRule()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    expected = {}
    for i in ids:
        text, spans = docs[i].text, finder.spans(docs[i].text)
        for s in reversed([s for k, s in enumerate(spans) if not any(o["start"] <= s["start"] < o["end"] for o in spans[:k])]):
            end = max([o["end"] for o in spans if s["start"] <= o["start"] < s["end"]])
            text = text[: s["start"]] + "[SECRET]" + text[end:]
        expected[i] = pieces.encode(text)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.ids for r in rows} == expected and len(rows) == len(expected)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_the_columns(spark, texts, folder):
    docs = texts([None, "", "same words in both of these texts here and more of them to be long enough for the rules " * 1, "password = abcdefgh"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    masked = {r.doc_id: r for r in corpus_pipeline.secrets(spark, docs, folder).collect()}
    assert masked[3].text == "[SECRET]" and masked[3].n_chars == 8 and masked[0].text is None


def test_stages_take_the_kinds_in_order():
    names = [re.sub("[^a-z]", "", name.lower()) for name, _ in corpus_pipeline.STAGES]
    assert [n[:7] for n in names] == ["quality", "ngramja", "benchma", "secrets", "sentenc"]


def test_stages_on_an_empty_table_null_ids_and_repeated_ids(spark, texts, folder):
    none = texts([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []
    docs = spark.createDataFrame([(None, "one text", "en", "s", 8), (1, "one text", "en", "s", 8), (1, "quite another text", "en", "s", 18), (None, None, None, None, None)], none.schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        found = sorted((r.doc_id or 0, r.source or "") for r in stage(spark, docs, folder).collect())
        assert found == [(0, ""), (0, "s"), (1, "s"), (1, "s")], name

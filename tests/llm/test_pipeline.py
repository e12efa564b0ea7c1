"""Every stage of the pipeline against plain Python, each on its own input."""

import hashlib

import corpus_pipeline
from tests.llm.test_corpus_ops import SMALL, components_by_force, documents, texts_of


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    seen = {"start": docs.cache()}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stage(spark, list(seen.values())[-1], SMALL).cache()
        if name != "byte_bpe":
            assert seen[name].columns == docs.columns
    texts = {name: texts_of(f) for name, f in seen.items() if name != "byte_bpe"}
    assert texts["language_id"] == [x for x in texts["start"] if any(c.isalpha() for c in x[1])]

    before, after = dict(texts["language_id"]), dict(texts["line_dedup"])
    for i, text in after.items():
        lines = iter(before[i].split("\n"))
        assert all(line in lines for line in text.split("\n"))  # what is left keeps its order
    gone = set(before) - set(after)
    others = {line for i in after for line in before[i].split("\n")}
    assert all(set(before[i].split("\n")) - {""} <= others for i in gone)

    roots = {i for i, _, root in components_by_force(texts["line_dedup"]) if i == root}
    assert {i for i, _ in texts["ngram_jaccard"]} == roots

    clean = {i for i, t in texts["ngram_jaccard"] if not any(item in t for item in items)}
    assert {i for i, _ in texts["decontamination"]} == clean

    coded = {r.doc_id: r for r in seen["byte_bpe"].collect()}
    assert set(coded) == clean
    for i, text in texts["decontamination"]:
        assert coded[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert coded[i].n_tokens * 4 == len(coded[i].ids)


def test_unlearned_scripts_go_and_labelled_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    odd = [
        "Съешь же ещё этих мягких французских булок, да выпей чаю",
        "Ο γρήγορος λύκος πηδάει πάνω από το τεμπέλικο σκυλί του χωριού",
        "我们今天在北京的图书馆里读了很多关于历史和科学的书籍然后一起去公园散步聊天直到晚上才回家吃饭",
        "".join(chr(0x430 + i * 7 % 32) + " " * (i % 5 == 0) for i in range(300)),
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    blank = docs.limit(1).drop("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(more.crossJoin(blank)), folder)
    want = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in kept.collect()} == want


def test_line_dedup_drops_passages_of_two_documents(spark):
    passage = " ".join(f"{chr(97 + i % 26)}word" for i in range(60))
    rows = [(1, f"own text one\n{passage}"), (2, f"{passage}\nother text two"), (3, "third text")]
    found = texts_of(corpus_pipeline.dedup_lines(spark, documents(spark, rows), SMALL))
    assert found == [rows[0], (2, "other text two"), rows[2]]


def test_stages_take_odd_documents(spark):
    rows = [(1, None), (2, ""), (None, "some words here"), (3, "x y z " * 9), (3, "x y z " * 9), (4, "12 34")]
    for source in (documents(spark, rows), documents(spark, [])):
        docs = source
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            if name != "byte_bpe":
                assert docs.columns == source.columns
        assert docs.count() <= len(rows)


def test_rows_without_id_and_rows_of_one_id(spark):
    """A benchmark item goes whatever its row's id; one row of an id stays."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    texts = [(None, item), (None, "a text of its own, without any id"), (1, "one and the same row"), (1, "one and the same row")]
    texts += [(2, "first text of the second id"), (2, "quite another text that it has"), (3, item), (4, None)]
    docs = documents(spark, texts)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["decontamination"](spark, docs, SMALL)
    assert clean.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in clean.collect()), key=str)
    assert left == sorted((t for t in texts if t[1] != item), key=str)
    kept = stages["ngram_jaccard"](spark, docs, SMALL).collect()
    ids = [r.doc_id for r in kept]
    # The item under 3 is near to nothing that has an id.
    assert sorted(ids, key=str) == sorted([None, None, 1, 2, 3, 4], key=str)
    assert next(r.text for r in kept if r.doc_id == 1) == "one and the same row"
    assert stages["ngram_jaccard"](spark, documents(spark, []), SMALL).count() == 0

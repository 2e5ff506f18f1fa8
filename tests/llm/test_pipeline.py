"""The pipeline's stages, each on its own input, and the registration of all queries."""

import corpus_pipeline as P
from tests.llm.test_dedup import brute_components, check_dedup, numbered
from tests.llm.test_format_and_pack import check_packing
from vexel.llm.queries import ORACLES, QUERIES


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "packed"]
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_the_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns and kept.schema == docs.schema
        if name == "language":
            assert {r["doc_id"] for r in kept.collect()} == {d for d, t in texts.items() if any(c.isalpha() for c in t)}
        if name == "repeated_passages":
            was, now = ({r["doc_id"]: r for r in t.collect()} for t in (before, kept))
            check_dedup({d: r["text"] for d, r in was.items()}, {d: now[d]["text"] if d in now else "" for d in was})
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] != was[d]["text"] else was[d]["n_chars"]) for d, r in now.items())
        if name == "near_duplicates":
            groups = {c for _, c in brute_components(sorted(texts.items())).values()}
            assert {r["doc_id"] for r in kept.collect()} == groups
        if name == "benchmark_leaks":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(i in r["text"] for r in kept.collect() for i in items)
            gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in kept.collect()}
            assert all(any(i.split()[2] in texts[d] for i in items) for d in gone)
    pieces = P.STAGES[-1][1](spark, kept, sf).collect()
    n = check_packing([(r["doc_id"], r["text"]) for r in kept.collect()], pieces, 2048)
    assert n <= 1.05 * -(-sum(r["length"] for r in pieces) // 2048) + 1


def test_only_the_languages_that_are_to_be_kept_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400 and n_chars > 200")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    for keep in (("en",), ("de", "fr"), ()):
        left = {r["doc_id"] for r in P.language(spark, docs, "", keep).collect()}
        right = {d for d, x in lang.items() if x in keep}
        assert len(left ^ right) <= 0.02 * len(lang)


def test_hard_rows_pass_every_stage(spark, hard, empty):
    sf = "/root/testdata/sf0.001"
    for docs in (hard, empty):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            assert stage(spark, docs, sf).count() <= docs.count()
        P.STAGES[-1][1](spark, docs, sf).count()
    left = {r["doc_id"] for r in P.language(spark, hard, sf).collect()}
    assert left & {2, 3, 4, 5} == set() and {1, 6, 7} <= left
    assert sorted(r["doc_id"] or 0 for r in P.near_duplicates(spark, hard, sf).collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_emptied_documents_go(spark):
    passage = numbered(0, 90) + ". "
    docs = spark.createDataFrame([(1, passage), (2, passage), (3, "Something else. " + passage)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in P.repeated_passages(spark, docs, "").collect()}
    assert set(out) == {1, 3} and out[1] == passage and out[3].startswith("Something else. ") and len(out[3].split()) < 20

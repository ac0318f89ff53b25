"""Every operator on awkward rows, on an empty table, and with columns whose names clash."""

import pytest
from pyspark.sql import functions as F

from stowage.llm import lm_score, media, mixing, packing, quality, simhash, substring, token_counts, url_filter, warc
from tests.llm.conftest import documents

EACH_ROW = {
    "media": media.media_table,
    "lm": lm_score.scores,
    "mixing": mixing.mix_table,
    "quality": quality.verdicts,
    "simhash": simhash.near_duplicates,
    "wide simhash": simhash.near_copies,
    "substring": substring.removals,
    "token counts": lambda d: token_counts.count_edits(d, token_counts.sample_edits()),
}
STAGES = {"quality": quality.keep_good, "simhash": simhash.keep_one, "substring": substring.without_repeats, "mixing": mixing.mix}


def test_each_row_has_a_result(spark, awkward):
    docs = documents(spark, awkward)
    ids = sorted((r[0] for r in awkward), key=str)
    for name, operator in EACH_ROW.items():
        got = operator(docs)
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == ids, name
    pieces = packing.pack(docs).collect()
    assert sorted((r["doc_id"] for r in pieces if r["piece"] == 0), key=str) == ids


def test_stages_keep_the_columns(spark, awkward):
    docs = documents(spark, awkward)
    for name, stage in STAGES.items():
        got = stage(docs)
        assert got.columns == docs.columns, name
        assert got.dtypes == docs.dtypes, name


def test_what_the_stages_keep(spark, awkward):
    docs = documents(spark, awkward)
    ids = lambda stage: sorted((r["doc_id"] for r in STAGES[stage](docs).collect()), key=str)
    # Short, empty and repetitive texts go; the rest stays, whatever its id and however often it is there.
    assert ids("quality") == [4, 5, 5, 6, None]
    # No words are one group, the text of 4 and its double another; two texts of document 13 are no copies.
    assert ids("simhash") == sorted([1, 4, 6, 7, 8, 9, 10, 11, 13, 13], key=str)
    assert ids("substring") == sorted((r[0] for r in awkward), key=str)
    copies = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mixing.mix_table(docs).where("doc_id not in (5, 13)").collect()}
    mixed = ids("mixing")
    assert {i: mixed.count(i) for i in copies} == copies
    assert not {1, 2, 3} & set(mixed) and max(mixed.count(i) for i in (4, 6, 7, 11)) <= 3


def test_empty_tables(spark):
    docs = documents(spark, [])
    for name, operator in (EACH_ROW | STAGES).items():
        assert operator(docs).collect() == [], name
    assert packing.pack(docs).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string, host string, digest string")
    assert warc.warc_table(pages).collect() == []
    assert url_filter.url_table(pages).collect() == []


def test_repeated_rows_and_copies_agree(spark, awkward):
    docs = documents(spark, awkward)
    rows = media.media_table(docs).where(F.col("doc_id") == 5).drop("doc_id").distinct().collect()
    assert len(rows) == 1
    removed = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring.removals(docs).collect()}
    assert removed[(4, 120)] == 0
    assert removed[(5, 120)] == 120
    assert removed[(None, 120)] == 120
    assert removed[(12, 240)] == 240
    assert removed[(11, 500)] == 499
    kept = simhash.keep_one(docs).collect()
    assert len([r for r in kept if r["text"] == awkward[3][1]]) == 1


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_a_stage_that_keeps_nothing(spark, stage):
    docs = documents(spark, [(1, None, None), (2, "", "a")])
    got = STAGES[stage](docs)
    assert got.columns == docs.columns
    assert len(got.collect()) == {"quality": 0, "simhash": 1, "substring": 2, "mixing": 0}[stage]


@pytest.mark.parametrize("empty", [False, True])
def test_the_pipeline_on_awkward_rows(spark, tmp_path, awkward, empty):
    import corpus_pipeline

    documents(spark, [] if empty else awkward).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == (set() if empty else {4, 6})
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        assert [at for at, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:k]) for k in range(len(items))]


def test_the_pipeline_on_texts_without_any(spark, tmp_path):
    import corpus_pipeline

    documents(spark, [(1, None, None), (None, "", "a"), (2, " ", "b")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_awkward_pages(spark):
    rows = [
        (1, None, None, "h", "d"), (2, "", "", "h", "d"), (3, "http://A.Example.ORG/es/x?y", "<p>", "h", "d"), (4, "no scheme", "<p>", "h", "d"), (4, "no scheme", "<p>", "h", "d"),
        (None, "https://x.com/fr/", "<p>", "h", "d"), (6, "a://b://c/d", "q" * 300_000, "h", "d"), (7, "https://evil\r\nX: y/", None, "h", "d"), (8, "ftp://h?x", "é\x00", "h", "d"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, digest string")
    judged = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_table(pages).collect()}
    assert judged[1] == judged[2] == judged[4] == ("", "", None, "allow")
    assert judged[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert judged[None] == ("x.com", "/fr/", "com/fr/", "allow")
    assert judged[6][:2] == ("b:", "//c/d")
    assert judged[8][:2] == ("h", "")
    got = warc.warc_table(pages).collect()
    assert sorted((r["page_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"]) == ("revisit", 7)
    assert (by[3]["record_type"], by[3]["refers_to"], by[3]["payload_bytes"]) == ("revisit", 4, 3)
    assert by[4]["record_type"] == "response"
    assert by[6]["payload_bytes"] == 300_000
    assert by[None]["refers_to"] == 4


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from stowage.llm import common

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://head:7077", setCheckpointDir=lambda _: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda _, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(session)
    context.master = "local[4]"
    assert common.shared_dir(session).startswith("file://")


def test_tables_that_nothing_reads_are_dropped(spark):
    import os

    from stowage.llm import common

    rows = spark.range(5)
    before = common.Written(rows, "before")
    mark = common.tables_written()
    one, two = common.Written(rows, "one"), common.Written(rows, "two")
    common.drop_since(spark, mark, two.df.where("id > 2"))
    there = lambda w: os.path.isdir(w.path.removeprefix("file://"))
    assert [there(w) for w in (before, one, two)] == [True, False, True]
    assert two.df.count() == 5
    before.drop()
    two.drop()

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.fixtures import documents
from tokenloom.llm import registry


def test_stages_are_in_order_and_queries_registered():
    assert [n for n, _ in p.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    names = registry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11)) and set(registry.oracle_sql()) <= set(names)


def test_token_stage_takes_awkward_rows(spark):
    docs = documents(spark)
    got = Counter(r.doc_id for r in p.token_stage(spark, docs, "").collect())
    assert got == Counter(r.doc_id for r in docs.collect())
    assert p.token_stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("k", range(4))
def test_each_stage_keeps_columns_and_takes_awkward_rows(spark, k):
    docs = documents(spark)
    out = p.STAGES[k][1](spark, docs, "")
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = Counter(r.doc_id for r in out.collect())
    clean = {i for i in range(20) if i not in (5,)}
    assert clean <= set(got)
    assert p.STAGES[k][1](spark, docs.limit(0), "").count() == 0


def test_near_duplicates_leave_one_of_each_group(spark):
    ids = {r.doc_id for r in p.near_duplicate_stage(spark, documents(spark), "").collect()}
    assert 30 in ids and not {31, 32, 33, 34} & ids and {24, 20, 21, 22, None} <= ids and 25 not in ids


def test_language_stage_rejects_texts_without_letters(spark):
    ids = {r.doc_id for r in p.language_stage(spark, documents(spark), "").collect()}
    assert not {20, 21, 22} & ids


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    want = docs
    for _, stage in p.STAGES:
        want = stage(spark, want, "")
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect())) and got
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(got[0].asDict())


def test_line_stage_drops_short_lines_too(spark):
    own = [f"line of document {c} with {c * 3} and {c * 5} that no other has" for c in "abcd"]
    data = [(1, f"All rights reserved.\n{own[0]}\n\nLes.\n7"), (2, f"{own[1]}\nLes.\n\nAll  rights reserved.\n8"), (3, f"Les.\n{own[2]}\nLes\nOf, edti oner."), (None, f"Of, edti oner.\n{own[3]}\n8\n9")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.text for r in p.line_stage(spark, docs, "").collect()}
    assert got == {1: data[0][1], 2: f"{own[1]}\n\n8", 3: f"{own[2]}\nLes\nOf, edti oner.", None: f"{own[3]}\n9"}


def test_one_row_of_each_group_stays_where_ids_repeat_or_are_null(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    data = [(1, a, "s"), (1, a, "r"), (1, a, "r"), (None, a, "q"), (7, a + " more", "s"), (None, b, "s"), (None, b, "r"), (None, b + " more", "r"), (1, c, "s"), (2, c, "s"), (2, d, "s"), (3, "", "s"), (3, "", "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = [tuple(r) for r in p.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(r for r in got if r[0] is not None) == [(1, a, "r"), (1, c, "s"), (2, d, "s"), (3, "", "s"), (3, "", "s")]
    assert len(got) == 6 and next(r[1] for r in got if r[0] is None) in (b, b + " more")


def test_lines_recur_among_rows_with_one_id_or_without(spark):
    line = "a line that recurs in each of these rows"
    own = [f"line of document {c} that no other document has" for c in ("one", "two", "three", "four")]
    docs = spark.createDataFrame(list(zip([4, 4, None, None], (f"{line}\n{x}" for x in own))), "doc_id long, text string")
    got = [tuple(r) for r in p.line_stage(spark, docs, "").collect()]
    assert sum(line in t for _, t in got) == 1 and next(i for i, t in got if line in t) == 4
    assert all(sum(x in t for _, t in got) == 1 for x in own)

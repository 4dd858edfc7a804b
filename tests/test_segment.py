import random

import pytest
from pyspark.sql import functions as F

from tokenloom.api import Segmenter
from tokenloom.functions import tags
from tokenloom.operators import kernels, native, segment, tagging
from tokenloom.plans import lexicon_queries as q
from tokenloom.streaming import segment_stream as stream

TEXT = "中华人民共和国结婚的尚未简称é a1.。，"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(TEXT) for _ in range(n))) for i, n in enumerate([0, 1, 5, 30, 400, 1500] * 3)] + [(98, "x" * 2000), (99, None)]
    return spark.createDataFrame(rows, "id long, text string")


OTHER = segment.Options(compat=True, extended_time=True, split_len=5, max_len=40)


@pytest.mark.parametrize("method, options", [*((m, segment.Options()) for m in (*kernels.METHODS, "tagging")), ("full", OTHER), ("tagging", OTHER)])
def test_native_equals_arrow(spark, texts, method, options):
    """Tokens of both engines are the same, typed, merged and tagged, also where rows repeat."""
    lexicon = q.toy(spark).unionByName(spark.createDataFrame([("中国", "ns", 7), ("和", "c", 4), ("二十", "n", 3), ("十三", "n", 2)], q.lex.SCHEMA))
    numbers = [(200, "中国人民3.14二十"), (201, "二十三和3.14.15 2015年12月"), (202, "18:21和2015/03/17"), (203, "3.14" * 30 + "。二十"), (204, "1 2。3"), (200, "中国人民3.14二十")]
    moves = spark.createDataFrame([("n", "n", 3), ("n", "c", 9), ("ns", "c", 2), ("c", "n", 5)], "prev string, next string, freq long") if method == "tagging" else None
    df = texts.unionByName(spark.createDataFrame(numbers, "id long, text string"))
    name = "unigram" if method == "tagging" else method
    got, want = (sorted(segment._split(df, "text", name, lexicon, options, moves, engine).select("id", "tokens").collect(), key=repr) for engine in ("native", "arrow"))
    assert got == want


@pytest.mark.parametrize("name", ["forward", "backward", "full", "smart", "tagging"])
def test_document_queries_equal_their_native_twins(spark, name):
    """The registered queries over a whole real table against the native engine, token by token."""
    import hashlib
    import struct

    sf = "/root/testdata/sf0.001"
    query = q.unigram_documents if name == "smart" else getattr(q, f"{name}_documents")
    got = {r.doc_id: (r.n_tokens, r.digest) for r in query(spark, sf).collect()}
    lexicon, moves = q.derived(spark, sf), None
    if name == "tagging":
        trained = q.training.train(q.annotated(spark, sf))
        lexicon, moves = q.lex.union(trained["lexicon"], lexicon), trained["transition"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(4)
    n = 0
    for r in segment.tokenize(docs, "text", lexicon.persist(), name, moves, engine="native").collect():
        data = None if r.tokens is None else b"".join(struct.pack("<3i", t.start, t.end, t.pos) for t in r.tokens)
        assert got[r.doc_id] == ((None, None) if data is None else (len(r.tokens), hashlib.sha256(data).hexdigest()))
        n += 1
    assert n == len(got)


def test_tokenize_goes_native_beyond_the_check(spark, texts, monkeypatch):
    few = texts.where("id < 6")
    want = {m: sorted(segment.tokenize(few, "text", q.toy(spark), m).collect()) for m in ("forward", "tagging")}
    monkeypatch.setattr(segment, "load", lambda *a, **k: (_ for _ in ()).throw(segment.LexiconTooLarge("too large")))
    assert {m: sorted(segment.tokenize(few, "text", q.toy(spark), m).collect()) for m in want} == want
    with pytest.raises(segment.LexiconTooLarge):
        segment.forward_split(few, "text", q.toy(spark))


def test_small_inputs_are_spread_over_the_cores(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "repeat(sha2(cast(id AS string), 256), 20) AS text").coalesce(1)
    df.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert segment.spread(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert segment.spread(one.limit(1)).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


def test_digests_are_those_of_the_tokens(spark, texts):
    import hashlib
    import struct

    for method in ("smart", "full"):
        got = {r.id: (r.n_tokens, r.digest) for r in segment.digests(texts, "text", q.toy(spark), method).collect()}
        for r in segment.tokenize(texts, "text", q.toy(spark), method).collect():
            data = None if r.tokens is None else b"".join(struct.pack("<3i", t.start, t.end, t.pos) for t in r.tokens)
            assert got[r.id] == ((None, None) if data is None else (len(r.tokens), hashlib.sha256(data).hexdigest()))


def test_byte_offsets_tile_and_typing_overrides(spark):
    df = spark.createDataFrame([(1, "中国人民2015年 3.14 www.sina.com.cn")], "id int, text string")
    (row,) = segment.forward_split(df, "text", q.toy(spark)).collect()
    assert [t.word for t in row.tokens] == ["中国", "人民", "2015", "年", " ", "3.14", " ", "www.sina.com.cn"]
    assert [t.pos for t in row.tokens] == [-1, -1, tags.T, -1, -1, tags.MA, -1, tags.URL]
    assert [t.start for t in row.tokens] == [0, 6, 12, 16, 19, 20, 24, 25]
    assert row.tokens[-1].end == len(row.text.encode())


def test_dispatch_and_empty_lexicon(spark, texts):
    few = texts.where("id < 4")
    empty = q.lex.empty(spark)
    assert segment.tokenize(few, "text", q.toy(spark), "nonsense").collect() == segment.full_split(few, "text", q.toy(spark)).collect()
    assert [len(r.tokens) for r in segment.forward_split(few.where("id = 0"), "text", empty).collect()] == [0]
    assert segment.forward_split(few.limit(0), "text", q.toy(spark)).count() == 0


def test_lexicon_size_is_checked(spark):
    with pytest.raises(segment.LexiconTooLarge):
        segment.load(q.toy(spark), limit=10)


def test_tag_words_equals_the_fold(spark):
    emissions, moves = q._hidden(spark)
    words = spark.createDataFrame([(i, s.split()) for i, s in enumerate(q.TAGGED, 1)] + [(9, None)], "key int, words array<string>")
    kernel = {r.key: r for r in tagging.tag_words(words, "words", emissions, moves).collect()}
    assert kernel[9].pos is None
    for r in q.viterbi_tags(spark, "").collect():
        assert " ".join(map(str, kernel[r.key].pos)) == r.tags and abs(kernel[r.key].cost - r.cost) < 1e-5


def test_roles_from_training_find_names(spark):
    from tokenloom.operators import training

    lines = spark.createDataFrame([(1, "王/nr 小明/nr 说/v"), (2, "李小龙/nr 来/v"), (3, "他/r 说/v")], "line_id int, line string")
    trained = training.train(lines)
    words = spark.createDataFrame([(1, ["王", "小", "明", "说"])], "key int, words array<string>")
    (r,) = tagging.role_tags(words, "words", trained["person_role"], trained["person_transition"]).collect()
    assert r.roles == ["B", "C", "D", "E"]


def test_segmenter_and_sql_functions(spark):
    s = Segmenter(q.toy(spark), spark.createDataFrame([("n", "n", 3)], "prev string, next string, freq long"))
    df = spark.createDataFrame([("结婚的和尚未结婚的",), (None,)], "text string")
    assert ["/".join(t.word for t in r.tokens) if r.tokens is not None else None for r in s.forward_split(df).collect()] == ["结婚/的/和尚/未/结婚/的", None]
    s.register(spark)
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT transform(smart_split(text), t -> t.word) AS w, transform(tagging(text), t -> t.pos) AS p FROM texts").collect()
    assert got[0].w == ["结婚", "的", "和", "尚未", "结婚", "的"] and got[0].p == [100] * 6 and got[1].w is None
    for name in ("forward_split", "backward_split", "full_split"):
        split = getattr(s, name)(df).select("tokens").collect()
        assert [r.t and [tuple(x) for x in r.t] for r in spark.sql(f"SELECT {name}(text) AS t FROM texts").collect()] == [r.tokens and [tuple(x) for x in r.tokens] for r in split]


def test_output_forms(spark):
    t = segment.forward_split(spark.createDataFrame([("中国 1.5",)], "text string"), "text", q.toy(spark))
    (r,) = t.select(segment.tagged_text(F.col("tokens")).alias("a"), segment.java_offsets(F.col("tokens")).alias("b"), q.sinks.formatted_tokens(F.col("tokens")).alias("c")).collect()
    assert r.a == "中国/-1  /-1 1.5/ma" and [tuple(x) for x in r.b] == [(0, 2), (2, 3), (3, 6)]
    assert r.c == "(0,6,-1,0)(6,7,-1,0)(7,10,30,0)"
    (r,) = t.select(q.sinks.token_text(F.col("tokens")).alias("a"), q.sinks.token_lengths(F.col("tokens")).alias("b"), tagging.tag_names(F.transform("tokens", lambda x: x["pos"])).alias("c")).collect()
    assert r.a == ["(0,6,中国)", "(6,7, )", "(7,10,1.5/ma)"] and r.b == [6, 1, 3] and r.c == ["-1", "-1", "ma"]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, "结婚的和尚未结婚的 abc") for i in range(5)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    tokens = stream.segment_stream(stream.read_texts(spark, str(tmp_path / "in")), "text", q.toy(spark))
    stream.write_tokens(tokens, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = segment.tokenize(df, "text", q.toy(spark), "forward")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
    counts = stream.word_counts(tokens).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    got = {r.word: r["count"] for r in spark.table("counted").collect()}
    assert got == {"结婚": 10, "的": 10, "和尚": 5, "未": 5, " ": 5, "abc": 5}


def test_windowed_counts_on_a_stream(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    df = spark.createDataFrame([(at(1), "中国 人民"), (at(9), "中国"), (at(12), "中国")], "at timestamp, text string")
    df.write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = stream.word_counts(stream.segment_stream(texts, "text", q.toy(spark), "smart"), "at")
    counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.window.start.minute, r.word, r["count"]) for r in spark.table("windows").collect())
    assert got == [(0, " ", 1), (0, "中国", 2), (0, "人民", 1), (10, "中国", 1)]


def test_large_lexicons_are_packed(spark, monkeypatch):
    """Words, tags and roles beyond the size of a dictionary: by packed tables, and beyond those by joins, all the same."""
    from tokenloom.operators import lexicon as lex
    from tokenloom.operators import packed, training

    trained = training.train(q.annotated(spark, "/root/testdata/sf0.001"))
    lexicon = lex.union(trained["lexicon"], q.derived(spark, "/root/testdata/sf0.001")).persist()
    roles, bigrams = trained["person_role"].persist(), trained["person_transition"].persist()
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(12).select("text")
    docs = turns.unionByName(spark.createDataFrame([(None,), ("",), ("é 二十 3.14 Éa",)], "text string")).selectExpr("monotonically_increasing_id() AS id", "text").persist()

    def found():
        digests = sorted(segment.digests(docs, "text", lexicon, "tagging", trained["transition"]).collect())
        names = tagging.recognize(docs, "text", q.toy(spark), roles, bigrams).select("id", "tokens", "names")
        return digests, sorted(names.collect(), key=lambda r: r.id)

    want = found()
    assert any(r.names for r in want[1])
    small = lex.gathered
    monkeypatch.setattr(lex, "gathered", lambda table, word="word", limit=0: small(table, word, 2000))
    assert found() == want
    monkeypatch.setattr(packed, "WORDS", 100)
    assert found() == want


def test_packed_words_are_those_of_the_dictionary(spark):
    from tokenloom.operators import packed

    rows = [("中国", "n", 50), ("中国", "zz", 7), ("人民", "v", 20), ("人民", "a", 3), ("é la", None, None), ("la", "n", 0)]
    lexicon = spark.createDataFrame([*rows, *((f"w{i}", "n", i) for i in range(500))], "word string, tag string, freq long")
    plain, held = segment.load(lexicon), packed.load(lexicon, tags.TAG_IDS)
    assert (plain.reach, plain.total, plain.single) == (held.reach, held.total, held.single)
    for w in [*plain.words, "w500", "", "民"]:
        assert (w in plain.words, plain.words.get(w), plain.costs.get(w)) == (w in held.words, held.words.get(w), held.costs.get(w))
    assert held.table.pairs("人民") == [(103, 20), (110, 3)] and held.table.pairs("中国") == [(100, 50)] and held.table.pairs("x") == []
    text = "中国人民é la w7 人民中国la é"
    for method in kernels.METHODS:
        assert kernels.segment(text, method, held) == kernels.segment(text, method, plain)
    assert packed.load(lexicon.limit(0), tags.TAG_IDS).words.get("中国") is None


def test_large_inputs_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """A large file of one row group is not one task, nor are tasks left as large as the files."""
    monkeypatch.setattr(segment, "SPREAD_BYTES", 64 << 10)
    df = spark.range(20_000).selectExpr("id", "repeat(sha2(cast(id AS string), 256), 20) AS text").coalesce(1)
    df.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    size = int(one._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size > spark.sparkContext.defaultParallelism * segment.SPREAD_BYTES
    assert segment.spread(one).rdd.getNumPartitions() >= size // segment.SPREAD_BYTES


def test_hits_are_sought_at_first_characters_only(spark):
    texts = ["中国人民", "a中国", "中", "", "é中国人a", "国人国"]
    pieces = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    words = {"中国": 5, "国人": 2, "中国人民": 1, "a中": 4, "é中国": 3, "人": 9}
    lexicon = spark.createDataFrame([(w, "n", f) for w, f in words.items()], "word string, tag string, freq long")
    want = [(k, i, j, words[t[i:j]]) for k, t in enumerate(texts) for i in range(len(t)) for j in range(i + 2, len(t) + 1) if t[i:j] in words and t[i] != "a"]
    hits = native.char_hits(pieces, lexicon)
    assert sorted(map(tuple, hits.collect())) == want
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower()  # once a character and a pattern, which took most of the time
    assert native.char_hits(pieces, lexicon.where("word = '人'")).collect() == []


def test_workers_hold_parts_of_a_batch():
    """What Python makes of a batch is sent on in parts, so that it does not grow with the batch."""
    import pyarrow as pa

    from tokenloom.operators import training

    texts = ["中国 " * 40, None, "", "x" * 3_000_000, *["中国/n 人民/n 说/v " * 100] * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    held = type("Sent", (), {"value": (kernels.Lexicon({"中国": 5, "人民": 2}), None)})()
    for run in (segment._run("forward", held, segment.Options(), "text"), training._parse("text")):
        out = list(run(iter([batch])))
        assert [x for b in out for x in b.column("id").to_pylist()] == list(range(len(texts)))
        assert max(b.num_rows for b in out) < 1000

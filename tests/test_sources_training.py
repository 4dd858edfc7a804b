import pytest

from tokenloom.operators import training as t
from tokenloom.sources import sinks
from tokenloom.sources import text as s

CORPUS = {
    1: "中央/n 电视台/n 报道/v 。/w", 2: "[中央/n 电视台/n]nt 记者/n 王/nr 石/nr 报道/v", 3: "[北京/ns 大学/n]/nt", 4: "王/nr 小明/nr 说/v", 5: "//w", 6: "/w", 7: "中央", 8: "（中央）/n",
    9: "中央/n]nt", 10: "[a/n [b/n c/n]nt", 11: "中央/n/b", 12: "http://a.com/nx",
}


@pytest.mark.parametrize(
    "token, parsed",
    [
        ("[中央/n", ("中央", "n", True, False, "")), ("中央/n]/nt", ("中央", "n", False, True, "nt")), ("中央/n]nt", ("中央", "n", False, True, "nt")), ("中央/n/b", ("中央", "n", False, False, "")),
        ("//w", ("/", "w", False, False, "")), ("/w", (" ", "w", False, False, "")), ("http://a.com/nx", ("http://a.com", "nx", False, False, "")), ("1/2/m", ("1/2", "m", False, False, "")),
    ],
)
def test_tokens(token, parsed):
    assert t.parse_entity(token) == parsed


def test_bad_tokens():
    for token in ("中央", "/", "（中央）/n", "(abcd/n", "abcd,/n"):
        with pytest.raises(t.ParseError):
            t.parse_entity(token)


def test_three_names_pair_from_the_left():
    assert [w for w, *_ in t.parse_line("王/nr 石/nr 李/nr")] == ["王石", "李"]


def test_training_counts(spark):
    lines = spark.createDataFrame(list(CORPUS.items()), "line_id long, line string")
    got = {k: sorted(map(tuple, df.collect())) for k, df in t.train(lines).items()}
    assert ("中央电视台", "nt", 1) in got["lexicon"] and ("电视台", "n", 2) in got["lexicon"] and ("王石", "nr", 1) in got["lexicon"]
    # the pair within the composite that ends line 3 does not count
    assert got["transition"] == [("n", "n", 3), ("n", "nr", 1), ("n", "v", 1), ("nr", "nr", 2), ("nr", "v", 2), ("v", "w", 1)]
    assert got["stats"] == [(23, 23)] and got["errors"] == [(12, 4)]
    assert got["name_shape"] == [("BCD", 1), ("BD", 1)]
    assert ("王", "B", 2) in got["person_role"] and ("小", "C", 1) in got["person_role"] and ("说", "E", 1) in got["person_role"]
    assert ("D", "E", 2) in got["person_transition"]


def test_readers_and_dictionary_round_trip(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text(" 中国/n \n\n\t人民/n\r\n")
    (tmp_path / "c" / "b.dat").write_text("no/n\n")
    lines = s.read_corpus(spark, str(tmp_path / "c"))
    assert sorted(r.value for r in lines.collect()) == ["中国/n", "人民/n"]
    assert [r.text for r in s.read_whole(spark, str(tmp_path / "c" / "b.dat")).collect()] == ["no/n"]
    lexicon = spark.createDataFrame([(f"w{i}", "n", 1000) for i in range(500)], "word string, tag string, freq long")
    sinks.save_dictionary(str(tmp_path / "d"), lexicon=lexicon)
    (back,) = sinks.open_dictionary(spark, str(tmp_path / "d"), "lexicon")
    assert sorted(back.collect()) == sorted(lexicon.collect())


def test_user_entries(spark):
    lines = spark.createDataFrame([("a\t5\tn",), ("b",), ("c\t3",), ("d\tx\tv",), ("",)], "value string")
    assert sorted(map(tuple, s.user_entries(lines).collect())) == [("a", "n", 5), ("b", None, None), ("c", None, None), ("d", "v", 0)]
    assert sorted(r.word for r in s.user_entries(spark.createDataFrame([("ab\t1\tn",)], "value string"), reverse=True).collect()) == ["ba"]


def test_requests_and_log(spark):
    raw = spark.createDataFrame([("POST /?ip=1.2.3.4&key=k HTTP/1.1\r\nReferer: r\r\n\r\ndata=%E4%B8%AD+a", 0.5), ("GET / HTTP/1.1\r\n\r\n", 0.1)], "raw string, seconds double")
    got = s.requests(raw)
    post, get = got.collect()
    assert (post.method, post.ip, post.key, post.referer, post.data) == ("POST", "1.2.3.4", "k", "r", "中 a") and get.data is None
    assert sinks.access_log(got).collect()[0].value.endswith("\t0.500000\t1.2.3.4\t-")


def test_roles_lead_into_names(spark):
    lines = spark.createDataFrame([(i, "他/r 说/v 王小明/nr 来/v") for i in range(50)] + [(50, "王/nr 说/v")], "line_id long, line string")
    got = {k: {r[:2]: r[2] for r in map(tuple, df.collect())} for k, df in t.train(lines).items() if k.startswith("person")}
    assert got["person_transition"][("O", "S")] == got["person_transition"][("O", "B")] == 50
    assert got["person_role"][("王", "B")] == 51 and got["person_role"][("王", "S")] == 1
    names = {tuple(r) for r in t.listed_roles(spark.createDataFrame([("王",), ("李小龙",)], "word string")).collect()}
    assert names == {("王", "nr", 1), ("王", "B", 1), ("李小龙", "nr", 1), ("李", "B", 1), ("小", "C", 1), ("龙", "D", 1)}


def test_names_in_the_middle_of_a_text(spark):
    from tokenloom.api import Segmenter

    lines = spark.createDataFrame([(i, "他/r 说/v 王小明/nr 来/v 了/u") for i in range(20)] + [(30, "他/r 和/c 李龙/nr 说/v")], "line_id long, line string")
    tables = t.train(lines)
    s_ = Segmenter(tables["lexicon"].where("tag <> 'nr'"), tables["transition"], roles=tables["person_role"], role_transitions=tables["person_transition"])
    texts = spark.createDataFrame([(1, "他说王小明来了"), (2, "他和李小龙说"), (3, None), (4, "")], "id long, text string")
    got = {r.id: r for r in s_.recognize(texts).collect()}
    assert [n.word for n in got[1].names] == ["王小明"] and [x.word for x in got[1].tokens] == ["他", "说", "王小明", "来", "了"]
    assert [x.pos for x in got[1].tokens][2] == 108 and (got[1].names[0].start, got[1].names[0].end) == (6, 15)
    assert [n.word for n in got[2].names] == ["李小龙"] and got[3].tokens is None and got[3].names is None and got[4].names == []
    assert [x.word for x in s_.analyse(texts.where("id = 1"), flags=2).first().tokens][2] == "王小明" and s_.analyse(texts.where("id = 1"), flags=1).first().tokens[0].pos > 0


def test_recognize_equals_the_kernel(spark):
    import random

    from tokenloom.operators import kernels, segment, tagging

    rng = random.Random(5)
    roles = spark.createDataFrame([(c, r, rng.randint(1, 9)) for c in "王李小明龙说" for r in rng.sample("BCDEOS", 3)], "unit string, role string, freq long")
    bigrams = spark.createDataFrame([(a, b, rng.randint(1, 50)) for a in "BCDEOS" for b in "BCDEOS" if rng.random() < 0.7], "prev string, next string, freq long")
    texts = spark.createDataFrame([(i, "".join(rng.choice("王李小明龙说x。") for _ in range(rng.randint(1, 60)))) for i in range(40)], "id long, text string")
    lexicon = spark.createDataFrame([("小明", "n", 3)], "word string, tag string, freq long")
    split = segment.smart_split(texts, "text", lexicon).withColumn("w", segment.words_of(segment.F.col("tokens")))
    got = {r.id: [(x.start, x.end, x.pos) for x in r.tokens] for r in tagging.recognize(texts, "text", lexicon, roles, bigrams, max_len=12).collect()}
    found = 0
    for r in tagging.role_tags(split, "w", roles, bigrams).collect():
        want = kernels.recognize([(x.start, x.end, x.pos) for x in r.tokens], r.roles, 108, 12)
        assert got[r.id] == want
        found += sum(p == 108 for *_, p in want)
    assert found > 10


def test_from_a_folder_to_a_segmenter(spark, tmp_path):
    from tokenloom.api import open_segmenter
    from tokenloom.functions.chars import SEED_DELIMITERS
    from tokenloom.operators import builder
    from tokenloom.sources import config

    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.txt").write_text("他/r 说/v 王小明/nr 来/v\n中国/ns 人民/n\n坏行\n")
    (tmp_path / "corpus" / "b.txt").write_text("他/r 来/v\n")
    (tmp_path / "corpus" / "notes.md").write_text("no/n\n")
    for name, text in {"udf": "中国\n未知词\n", "names": "李小龙\n王\n", "firms": "中国银行\n"}.items():
        (tmp_path / name).write_text(text)
    lists = {"UDF": f"{tmp_path}/udf", "nr": f"{tmp_path}/names", "nt": f"{tmp_path}/firms"}
    tables = builder.build(spark, f"{tmp_path}/corpus", lists, f"{tmp_path}/out")
    lexicon = {(r.word, r.tag): r.freq for r in tables["lexicon"].collect()}
    assert lexicon["来", "v"] == 2 and lexicon["中国", "UDF"] == 1 and ("未知词", "UDF") not in lexicon and lexicon["李小龙", "nr"] == 1 and lexicon["中国银行", "nt"] == 1 and lexicon["，", "w"] == 10_000
    assert {(r.unit, r.role): r.freq for r in tables["person_role"].collect()}["王", "B"] == 2
    assert tables["stats"].first() == (8 + len(SEED_DELIMITERS), 8 + len(SEED_DELIMITERS)) and tables["errors"].first().n_errors == 1
    assert {r.word: r.freq for r in tables["inverse"].collect()}["明小王"] == 1

    (tmp_path / "user").mkdir()
    (tmp_path / "user" / "mine.txt").write_text("新词\t5\tn\n")
    (tmp_path / "conf").write_text(f"# settings\nDICT_ROOT = nowhere\nDICT_ROOT = {tmp_path}/out\nUSER_DICT_DIR={tmp_path}/user\nMAX_LEN=100x\nCOMPAT=TRUE\nRATIO= 2.5 \n")
    settings = config.load(spark, f"{tmp_path}/conf")
    assert (settings.integer("MAX_LEN"), settings.real("RATIO"), settings.flag("COMPAT"), settings.flag("IS_LOAD_INVS"), settings.integer("NONE", 7), settings.text("CORE_DICT_NAME")) == (100, 2.5, True, False, 7, "core")
    assert settings.options().max_len == 100 and settings.options().compat and settings.options().split_len == 60
    s_ = open_segmenter(spark, settings)
    assert s_.options.total == 8 + len(SEED_DELIMITERS)
    (r,) = s_.tagging(spark.createDataFrame([("中国人民说新词",)], "text string")).collect()
    assert [x.word for x in r.tokens] == ["中国", "人民", "说", "新词"] and r.tokens[2].pos == 103
    assert [n.word for n in s_.recognize(spark.createDataFrame([("他说王小明来",)], "text string")).first().names] == ["王小明"]


def test_gold_corpus(spark):
    lines = spark.createDataFrame([(1, "[中央/n 电视台/n]nt 记者/n"), (2, "坏行")], "line_id long, line string")
    (r,) = t.gold_sentences(t.entities(t.parse_corpus(lines))).collect()
    assert (r.sentence, r.words, r.tagged_words, r.tags) == ("中央电视台记者", ["中央电视台", "记者"], ["中央", "电视台", "记者"], ["n", "n", "n"])


def test_attributes(spark):
    from tokenloom.operators import lexicon as lex

    words = spark.createDataFrame([("a", "n", 3), ("a", "v", 2), ("b", "n", 1)], lex.SCHEMA)
    more = spark.createDataFrame([("a", "n", 9), ("b", "v", 4), ("c", "n", 1)], lex.SCHEMA)
    assert {tuple(r) for r in lex.set_attribute(words, more).collect()} == {("a", "n", 9), ("a", "v", 2), ("b", "n", 1), ("b", "v", 4)}
    assert {tuple(r) for r in lex.remove_attribute(words, more.select("word", "tag").union(spark.createDataFrame([("b", "n")], "word string, tag string"))).collect()} == {("a", "v", 2), ("b", None, None)}


def test_lookup_metadata_and_compat_frequency(spark, tmp_path):
    from tokenloom.operators import lexicon as lex

    words = spark.createDataFrame([("n", "n", 3), ("ab", "v", 2), ("ab", "n", 5), ("c", None, None)], lex.SCHEMA)
    ids = spark.createDataFrame([("n", 201), ("ab", 202), ("c", 203)], "word string, word_id long")
    asked = spark.createDataFrame([("ab",), ("c",), ("zz",)], "word string")
    answers = {r.word: r.answer for r in lex.lookup_text(words, ids, asked).collect()}
    assert answers == {"ab": "ab(id=202, total=7) n:5 v:2 ", "c": "c(id=203, total=0) null", "zz": "not found in dict"}
    assert lex.lookup_text(words, ids, spark.createDataFrame([("ba",)], "word string"), reverse=True).first().answer.startswith("ab(id=202")
    moves = spark.createDataFrame([("n", "v", 10), ("v", "n", 4)], "prev string, next string, freq long")
    assert {tuple(r) for r in lex.compat_frequency(words, moves).collect()} == {("n", 13), ("ab", 7), ("c", None), ("v", 4)}
    sinks.save_dictionary(str(tmp_path), "core", lexicon=words)
    assert sinks.name_dictionary(str(tmp_path), spark, "core", "the core", 200).first()[:2] == ("core", "the core")
    assert sinks.open_dictionary(spark, str(tmp_path), "metadata")[0].first()[3:] == (3, 203)


def test_ids_are_the_same_in_each_evaluation(spark):
    from tokenloom.operators import lexicon as lex

    words = spark.range(5000).selectExpr("concat('w', id * 7919 % 5000) AS word", "id AS freq")
    ids = lex.with_ids(words, "freq", after=200)
    got = sorted(tuple(r) for r in ids.join(ids.withColumnRenamed("word_id", "again"), "word").collect())
    assert sorted(r[1] for r in got) == list(range(201, 5201)) and all(r[1] == r[2] for r in got)
    assert [w for w, _, _ in sorted(got, key=lambda r: r[1])[:3]] == ["w0", "w2919", "w838"]


def test_requests_with_parameters(spark):
    df = spark.createDataFrame([("a", "x"), ("", "y"), (None, "z")], "data string, key string")
    assert [r.key for r in s.with_parameter(df, "data", "key").collect()] == ["x"]


def test_other_string_functions(spark):
    from pyspark.sql import functions as F

    from tokenloom.functions import chars

    df = spark.createDataFrame([("a::b::c", "中a国b"), ("::x", "é")], "x string, y string")
    got = df.select(chars.split_mark(F.col("x"), "::").alias("a"), chars.split_mark(F.col("x"), "::", 2).alias("b"), chars.truncated(F.col("y"), 5).alias("c"), chars.truncated(F.col("y"), 1).alias("d"), chars.upcase(F.col("y")).alias("e"), chars.is_whitespace(F.lit(" \t")).alias("f"), chars.is_whitespace(F.col("x")).alias("g"))
    assert [tuple(r) for r in got.collect()] == [(["a", "b", "c"], ["a", "b::c"], "中a", "", "中A国B", True, False), (["", "x"], ["", "x"], "é", "", "é", True, False)]

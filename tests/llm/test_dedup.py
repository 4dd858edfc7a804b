import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, rows, sentence
from tokenloom.llm import exact_dedup, jaccard_join, line_dedup


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda c: (F.octet_length(c) % 3).cast("long")])
def test_exact_dedup_equals_brute_force(spark, hash_of):
    """Also where the chunk hash is so poor that all contents collide."""
    data = rows()
    groups = defaultdict(list)
    for i, t in data:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    want = sorted((repr(i), repr(sorted(groups[plain(t)])[0][3]), len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in data)
    got = exact_dedup.exact_dedup(documents(spark), hash_of).collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(documents(spark).limit(0)).count() == 0


def brute_components(data, least=75):
    sets, ids = [], []
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])))
        ids.append(i)
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= least * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least_id = {}
    for k, i in enumerate(ids):
        least_id.setdefault(find(k), []).append(i)
    return sorted((repr(i), len(sets[k]), repr(min((x for x in least_id[find(k)] if x is not None), default=None))) for k, i in enumerate(ids))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    data = rows(seed)
    for g in range(4):  # groups of near copies around the threshold, and a passage that many share
        base, shared = sentence(rng, 90).split(), sentence(rng, 40)
        for k in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            data.append((100 + 20 * g + k, " ".join(w)))
            data.append((300 + 20 * g + k, shared + " " + sentence(rng, rng.randint(5, 60))))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = jaccard_join.jaccard_components(df, hot_from=3).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_components(data)


def near_copies(rng, first: int, n: int, most: int = 14):
    base = sentence(rng, 60).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh") * 3
        out.append((first + k, " ".join(w)))
    return out


def test_large_groups_in_split_tiles_equal_brute_force(spark, monkeypatch):
    """Groups of near copies, exact copies and one id for many rows, with small tiles and all hot keys dealt."""
    import random

    from tokenloom.llm import common

    rng = random.Random(9)
    data = [*near_copies(rng, 0, 150), *near_copies(rng, 1000, 90, 30), *((2000 + k, "the very same text of some ten words in each row") for k in range(120)), *rows(9)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_components(data)
    monkeypatch.setattr(common, "HOT_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 8)
    for gain in (0.5, 2.0):  # with rounds of stars, and after one round by tiles alone
        monkeypatch.setattr(jaccard_join, "GAIN", gain)
        got = jaccard_join.jaccard_components(df, hot_from=3).collect()
        assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == want


@pytest.mark.parametrize("small", [0, 1 << 17])
def test_small_tables_of_links_and_large_ones_give_the_same(spark, monkeypatch, small):
    """Links of up to SMALL rows are contracted in one task, without rounds of stars over them; of what pairs look up, only
    the rows that they name go through a shuffle, whether pairs are sent to the workers or a filter of them."""
    import random

    rng = random.Random(4)
    data = [*near_copies(rng, 0, 60), *near_copies(rng, 1000, 60, 30), *rows(4), *((2000 + k, sentence(rng, 70)) for k in range(300))]
    large, narrowed = [], []
    for name, seen in (("components", large), ("_narrowed", narrowed)):
        f = getattr(jaccard_join, name)
        monkeypatch.setattr(jaccard_join, name, lambda *a, f=f, seen=seen: (out := f(*a), seen.append((a[0].columns, out.count())))[0])
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 8)
    got = jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), hot_from=3)
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got.collect()) == brute_components(data)
    assert bool(large) == (small == 0)
    classes = [n for columns, n in narrowed if "bbits" in columns]
    assert classes and max(classes) < len(data) / 2


def test_links_of_one_task_are_contracted_to_the_least_nodes(spark, monkeypatch):
    import random

    rng = random.Random(6)
    nodes = [b"%03d" % k for k in range(120)]
    for _ in range(3):
        links = [tuple(rng.choices(nodes, k=2)) for _ in range(70)] + [(nodes[5], nodes[5])]
        df = spark.createDataFrame(links, "a binary, b binary")
        got = []
        for small in (1 << 17, 0):
            monkeypatch.setattr(jaccard_join, "SMALL", small)
            known = jaccard_join.joined(None, df.where("a < '060'"))
            got.append(sorted((bytes(r.u), bytes(r.root)) for r in jaccard_join.joined(known, df.where("a >= '060'")).collect()))
        assert got[0] == got[1] and all(root < u for u, root in got[0])


def test_tiles_make_fewer_links_than_rows(spark, monkeypatch):
    """However many pairs of a tile link: what is written of them is a forest."""
    import random

    seen = []
    joined = jaccard_join.joined
    monkeypatch.setattr(jaccard_join, "joined", lambda known, links: (seen.append(links.count()), joined(known, links))[1])
    monkeypatch.setattr(jaccard_join, "GAIN", 2.0)
    base = sentence(random.Random(2), 60)
    data = [(k, f"{base} own{k} words{k}") for k in range(200)]  # all pairs link
    got = jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(seen) <= 2 * len(data)


def test_jaccard_over_a_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = jaccard_join.op6_jaccard_join(spark, sf).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_components(data)


def test_filters_and_what_the_driver_gathers_are_bounded(spark):
    from tokenloom.llm import common

    df = spark.range(200_000).selectExpr("xxhash64(id) AS h")
    f = common.bit_filter(df, "h")
    assert f.count() <= common.FILTER_BITS // 64
    met, not_met = common.split_by(spark.range(300_000).selectExpr("id", "xxhash64(id) AS h"), "h", f)
    assert met.where("id < 200000").count() == 200_000 and met.count() + not_met.count() == 300_000
    hot = common.hot_keys(spark.range(100_000).selectExpr("if(id < 60000, 1, id) AS k"), "k")
    assert [k for k, _ in hot] == [1] and len(hot) <= common.SPREAD


def test_dealt_joins_equal_joins(spark, monkeypatch):
    from tokenloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.range(200).selectExpr("if(id < 120, 1, id % 7) AS k", "id AS v").unionAll(spark.sql("SELECT CAST(NULL AS bigint), 999L"))
    right = spark.range(5).selectExpr("id AS k", "id * 10 AS x")
    for how in ("inner", "left"):
        got = common.dealt_join(left, right, "k", "v", common.hot_keys(left, "k"), how)
        assert sorted(map(repr, got.select("k", "v", "x").collect())) == sorted(map(repr, left.join(right, "k", how).select("k", "v", "x").collect()))


def test_written_tables_go_when_they_are_discarded(spark):
    import os

    from tokenloom.llm import common

    df = common.materialize(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and df.count() == 5
    common.discard(df)
    assert not os.path.isdir(path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with common.small_batches(spark):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as Fake

    from tokenloom.llm import common

    fake = Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(fake)


def test_jaccard_without_links_or_rows(spark):
    few = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(few).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert jaccard_join.jaccard_components(few.limit(0)).count() == 0


def test_bitmaps_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(5, 300), np.uint64)) for _ in range(2))
        size = min(len(jaccard_join.bitmap(a)), len(jaccard_join.bitmap(b)))
        x, y = (jaccard_join.folded(jaccard_join.bitmap(s), size) for s in (a, b))
        bound = jaccard_join.overlap_bound(len(a), len(b), int(np.bitwise_count(x ^ y).sum()))
        assert bound >= len(np.intersect1d(a, b))


def brute_lines(data):
    """Each line against the earlier documents' lines and against the first line of each of its leaves."""
    order, lines = lambda k: (data[k][0] is None, data[k][0] or 0), []
    for k, (_, t) in enumerate(data):
        for at, line in enumerate(t.split("\n") if t else []):
            w = line.encode().split()
            g = [b"<*>" if re.search(rb"[0-9]", x) else x for x in w]
            if w:
                lines.append((k, at, tuple(g if len(w) > 3 and 2 * sum(x != b"<*>" for x in g) >= len(w) else w)))
    drops = defaultdict(set)
    leaves = defaultdict(list)
    for line in lines:
        n = len(line[2])
        leaves[0, n, line[2]].append(line)
        for b in range(3 if n >= 10 else 0):
            leaves[b + 1, n, line[2][:3], line[2][n * b // 3 : n * (b + 1) // 3]].append(line)
    for key, members in leaves.items():
        head = min(members, key=lambda x: (order(x[0]), x[1]))
        for k, at, t in members:
            if order(head[0]) < order(k) and (key[0] == 0 or sum(x == y for x, y in zip(t, head[2])) >= 0.8 * len(t)):
                drops[k].add(at)
    return sorted((repr(i), repr(t if not drops[k] else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in drops[k])), len(drops[k])) for k, (i, t) in enumerate(data))


def test_line_dedup_equals_brute_force(spark):
    a = "an order number 12 was sent to the customer on the 3rd of may in good state"
    data = [*rows(), (50, a + "\nown line of fifty"), (51, a.replace("12", "99") + "\nother"), (52, a.replace("good", "bad") + "\nshort one"), (53, "\tone  two three four"), (54, "one two\x0bthree four\n\n")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("__drops", F.lit("clash")).withColumn("n_lines", F.lit("clash")).withColumn("same", F.lit(1)).withColumn("its_id", F.lit(1))
    got = line_dedup.line_dedup(df).collect()
    assert sorted((repr(r.doc_id), repr(r.text), r.n_dropped) for r in got) == brute_lines(data)
    assert {r.doc_id: r.n_lines for r in got}[20] == 0 and {r.doc_id: r.n_lines for r in got}[21] == 1
    kept = {r.doc_id for r in line_dedup.drop_documents(line_dedup.line_dedup(df)).collect()}
    assert 31 not in kept and {30, 50, 20, 21} <= kept
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_groups_like_lines_only(spark):
    data = [
        (1, "Read more\nShare this page\nthe committee met in paris to discuss the new budget for schools and roads\n1 2 3 4 5"),
        (2, "Read more\nShare this page\nthe committee met in paris to discuss why the dam above the valley failed\n1 2 3 4 6"),
        (3, "the committee met in paris to discuss the old budget for schools and roads"),
        (4, "the committee met in paris\nto discuss " + "x" * 200_000),
        (5, "the committee met in paris\nto discuss " + "x" * 200_000 + "y"),
    ]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[2] == "the committee met in paris to discuss why the dam above the valley failed\n1 2 3 4 6"
    assert got[1] == data[0][1] and got[3] == "" and got[4] == data[3][1] and got[5] == data[4][1].split("\n")[1]


def test_line_dedup_of_a_line_that_all_share(spark, monkeypatch):
    """Also where its key is dealt over several tasks."""
    from tokenloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 20)
    data = [(k, f"all of us have this line of ten words here{' too' * (k % 2)}\nown line w{k}") for k in range(200)]
    got = line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(k, int(k > 1)) for k in range(200)]

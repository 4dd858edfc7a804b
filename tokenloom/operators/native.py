"""The segmenters as joins and folds, without Python workers and without a limit on the lexicon.

A text is cut into chunks; candidate spans of a chunk meet the lexicon in a join; the choice is a fold over the chunk's
positions with the hits as a map. Positions are characters from 0 within the chunk.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import tags
from tokenloom.functions.chars import ALNUM, ATOM
from tokenloom.operators import kernels, typing
from tokenloom.operators import lexicon as lex

_PIECES = "struct<b:int,i:int,s:int,si:int,cur:int,out:array<struct<start:int,end:int,delimiter:boolean>>>"


def chunk_pieces(text: Column, split_len: int = 60, max_len: int = 890, delimiters: str = kernels.DELIMITERS) -> Column:
    """array<struct<start, end, delimiter>> of a text's pieces, in characters; the same as kernels.chunks."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    zero = F.struct(
        F.lit(0).alias("b"), F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("si"), F.lit(split_len).alias("cur"),
        F.array().cast("array<struct<start:int,end:int,delimiter:boolean>>").alias("out"),
    )
    piece = lambda a, z, d: F.struct(a.alias("start"), z.alias("end"), F.lit(d).alias("delimiter"))

    def step(x: Column, c: Column) -> Column:
        w = F.octet_length(c)
        skip = x["b"] < x["cur"]
        hard = x["b"] - x["s"] > max_len
        mark = c.isin(*delimiters)
        upto = F.when(x["i"] > x["si"], F.array(piece(x["si"], x["i"], False))).otherwise(F.array())
        new = lambda s, si, cur, out: F.struct((x["b"] + w).alias("b"), (x["i"] + 1).alias("i"), s.alias("s"), si.alias("si"), cur.alias("cur"), out.alias("out"))
        return (
            F.when(skip, new(x["s"], x["si"], x["cur"], x["out"]))
            .when(hard, new(x["b"], x["i"], x["b"] + split_len + w, F.concat(x["out"], upto)))
            .when(mark, new(x["b"] + w, x["i"] + 1, x["b"] + split_len + w, F.concat(x["out"], upto, F.array(piece(x["i"], x["i"] + 1, True)))))
            .otherwise(new(x["s"], x["si"], x["b"] + w, x["out"]))
            .cast(_PIECES)
        )

    tail = lambda x: F.when(x["si"] < x["i"], F.concat(x["out"], F.array(piece(x["si"], x["i"], False)))).otherwise(x["out"])
    return F.aggregate(chars, zero.cast(_PIECES), step, tail)


def rounded(x: Column) -> Column:
    """As kernels.rounded."""
    return F.floor(x * kernels.GRID + 0.5) / F.lit(kernels.GRID)


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, also where f uses it in a lambda: a column named before would be put there again."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _lexicon(lexicon: DataFrame) -> tuple[DataFrame, int]:
    """(word, freq), sent to all workers where its checked size allows, and the longest word."""
    words = lex.word_frequency(lexicon)
    longest, size = words.agg(F.max(F.char_length("word")), F.sum(F.char_length("word") + 16)).first()
    small = (size or 0) <= lex.BROADCAST_CHARS
    return (F.broadcast(words) if small else words), longest or 0


#: Alnum characters, and most characters by which starts of words are sorted out.
_ALNUM, FIRSTS = [c for c in map(chr, range(128)) if re.match(ALNUM, c)], 2_000


def char_hits(pieces: DataFrame, lexicon: DataFrame, key: str = "key") -> DataFrame:
    """(key, i, j, freq): words of two characters or more at characters i to j that do not begin in an alnum run."""
    words, longest = _lexicon(lexicon)
    if longest < 2:
        return pieces.select(key, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("freq")).where("false")
    firsts = words.where(F.char_length("word") > 1).select(F.substring("word", 1, 1).alias("c")).distinct().limit(FIRSTS + 1).collect()
    chars = pieces.select(key, F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("c")).where(F.size("c") > 1)
    begins = lambda c: c.isin([r.c for r in firsts]) if len(firsts) <= FIRSTS else F.lit(True)
    starts = F.filter(F.sequence(F.lit(0), F.size("c") - 2), lambda i: begins(F.get("c", i)) & ~F.get("c", i).isin(*_ALNUM))
    # only what a word may take goes on from the text, as a row for each start would repeat it
    spots = chars.select(key, F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), F.slice("c", i + 1, F.lit(longest)).alias("c")))).alias("s")).select(key, "s.*")
    spans = spots.where(F.size("c") > 1).select(key, "i", F.explode(F.transform(F.sequence(F.lit(2), F.size("c")), lambda k: F.struct(k.alias("len"), F.array_join(F.slice("c", F.lit(1), k), "").alias("word")))).alias("s"))
    return spans.select(key, "i", (F.col("i") + F.col("s.len")).alias("j"), F.col("s.word").alias("word")).join(words, "word").select(key, "i", "j", "freq")


def _with_map(pieces: DataFrame, hits: DataFrame, key: str, value: Column) -> DataFrame:
    """pieces with hits: map of i to what is chosen there; at most one entry a character of a chunk."""
    best = hits.groupBy(key, "i").agg(value.alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("hits"))
    return pieces.join(best, key, "left")


def _run_end(text: Column, i: Column) -> Column:
    return i + F.char_length(F.regexp_extract(F.substring(text, i + 1, F.char_length(text)), f"^{ALNUM}+", 0))


_SPANS = "array<struct<start:int,end:int>>"


def forward_spans(pieces: DataFrame, lexicon: DataFrame, key: str = "key") -> DataFrame:
    """pieces (key, text) with spans by forward maximum match."""
    chosen = _with_map(pieces, char_hits(pieces, lexicon, key), key, F.max("j"))
    state = f"struct<at:int,out:{_SPANS}>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")).cast(state)

    def step(x, i):
        run = _run_end(F.col("text"), i)
        to = F.when(run > i, run).otherwise(F.coalesce(F.try_element_at("hits", i), i + 1))
        return F.when(i < x["at"], x).otherwise(F.struct(to.alias("at"), F.array_append(x["out"], F.struct(i.alias("start"), to.alias("end"))).alias("out")).cast(state))

    spots = F.when(F.char_length("text") > 0, F.sequence(F.lit(0), F.char_length("text") - 1)).otherwise(F.array().cast("array<int>"))
    return chosen.withColumn("spans", F.aggregate(spots, zero, step, lambda x: x["out"])).drop("hits")


def backward_spans(pieces: DataFrame, lexicon: DataFrame, key: str = "key") -> DataFrame:
    turned = forward_spans(pieces.withColumn("text", F.reverse("text")), lexicon.withColumn("word", F.reverse("word")), key)
    n = F.char_length("text")
    mirrored = F.reverse(F.transform("spans", lambda s: F.struct((n - s["end"]).alias("start"), (n - s["start"]).alias("end"))))
    return turned.withColumn("spans", mirrored).withColumn("text", F.reverse("text"))


def full_spans(pieces: DataFrame, lexicon: DataFrame, key: str = "key") -> DataFrame:
    chosen = _with_map(pieces, char_hits(pieces, lexicon, key), key, F.array_sort(F.collect_list("j")))
    state = f"struct<at:int,last:int,out:{_SPANS}>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("last"), F.array().cast(_SPANS).alias("out")).cast(state)

    def step(x, i):
        run = _run_end(F.col("text"), i)
        found = F.coalesce(F.try_element_at("hits", i), F.array().cast("array<int>"))
        last = F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(x["last"])
        one = lambda end: F.struct(i.alias("start"), end.alias("end"))
        single = F.when(last <= i, F.array(one(i + 1))).otherwise(F.array()).cast(_SPANS)
        hit = F.struct((i + 1).alias("at"), last.alias("last"), F.concat(x["out"], F.transform(found, one), single).alias("out")).cast(state)
        whole = F.struct(run.alias("at"), x["last"].alias("last"), F.array_append(x["out"], one(run)).alias("out")).cast(state)
        return F.when(i < x["at"], x).when(run > i, whole).otherwise(hit)

    spots = F.when(F.char_length("text") > 0, F.sequence(F.lit(0), F.char_length("text") - 1)).otherwise(F.array().cast("array<int>"))
    return chosen.withColumn("spans", F.aggregate(spots, zero, step, lambda x: x["out"])).drop("hits")


def atom_edges(pieces: DataFrame, lexicon: DataFrame, total: int | None = None, key: str = "key") -> DataFrame:
    """(key, i, j, word, freq, cost): the lattice of each piece, positions in atoms."""
    words, longest = _lexicon(lexicon)
    total = lexicon.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0] if total is None else total
    cells = pieces.select(key, F.regexp_extract_all("text", F.lit(ATOM), F.lit(0)).alias("atoms"))
    spots = cells.select(key, "atoms", F.posexplode("atoms").alias("i", "atom"))
    ends = F.sequence(F.col("i") + 1, F.least(F.size("atoms"), F.col("i") + max(1, longest)))
    cand = spots.select(key, "i", F.explode(ends).alias("j"), "atoms").select(key, "i", "j", F.array_join(F.slice("atoms", F.col("i") + 1, F.col("j") - F.col("i")), "").alias("word"))
    hits = cand.join(words, "word", "left").where("freq IS NOT NULL OR j = i + 1").withColumn("freq", F.coalesce("freq", F.lit(1)))
    return hits.select(key, "i", "j", "word", "freq", rounded(-F.log((F.col("freq") + 1) / F.lit(float(total + 1)))).alias("cost"))


def unigram_paths(pieces: DataFrame, lexicon: DataFrame, total: int | None = None, key: str = "key") -> DataFrame:
    """(key, cost, words): the cheapest path of each piece by a fold over its edges in order."""
    edges = atom_edges(pieces, lexicon, total, key)
    lists = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "j", "cost", "word"))).alias("e"), F.max("j").alias("n"))
    cell = "struct<c:double,i:int,w:string>"
    first = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.struct(F.when(k == 0, 0.0).otherwise(F.lit(float("inf"))).alias("c"), k.cast("int").alias("i"), F.lit("").alias("w")).cast(cell))

    def relax(x, e):
        new = F.get(x, e["i"])["c"] + e["cost"]
        better = new < F.get(x, e["j"])["c"]
        return F.when(better, F.transform(x, lambda v, k: F.when(k == e["j"], F.struct(new.alias("c"), e["i"].alias("i"), e["word"].alias("w")).cast(cell)).otherwise(v))).otherwise(x)

    state = "struct<at:int,out:array<string>>"
    zero = F.struct(F.col("n").alias("at"), F.array().cast("array<string>").alias("out")).cast(state)

    def path(best):
        def back(x, _):
            here = F.get(best, x["at"])
            return F.when(x["at"] == 0, x).otherwise(F.struct(here["i"].alias("at"), F.array_append(x["out"], here["w"]).alias("out")).cast(state))

        words = F.aggregate(F.sequence(F.lit(1), F.col("n")), zero, back, lambda x: F.reverse(x["out"]))
        return F.struct(F.get(best, F.col("n"))["c"].alias("cost"), words.alias("words"))

    return lists.select(key, F.aggregate("e", first, relax, path).alias("best")).select(key, "best.*")


def _tags(words: DataFrame, lexicon: DataFrame, transitions: DataFrame, key: str = "key") -> DataFrame:
    """(key, tags): the cheapest tag of each of words (key, words), by a join with the lexicon and a fold."""
    from tokenloom.operators import segment, tagging

    ids = tags.TAG_IDS
    moves = {(ids[a], ids[b]): f for a, b, f in segment.known_moves(transitions, ids)}
    sums: dict[int, int] = {}
    for (a, _), f in moves.items():
        sums[a] = sums.get(a, 0) + f
    mapped = lambda d, kind: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast(kind) if d else F.create_map().cast(kind)
    known = lexicon.where(F.col("tag").isin(*ids)).groupBy("word", "tag").agg(F.sum("freq").alias("f"))
    total = known.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    tag = F.element_at(mapped(ids, "map<string,int>"), F.col("tag"))
    cands = known.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(tag.alias("tag"), "f"))).alias("o"))  # at most a row a tag
    unknown = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(f).cast("long").alias("f")) for t, f in segment.prior(sums, ("n", "a", "v", "c", "u", "p"))))
    each = words.select(key, F.posexplode("words").alias("i", "word")).join(cands, "word", "left").withColumn("o", F.coalesce("o", unknown))
    lists = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: x["o"]).alias("obs"))
    best = tagging.viterbi_fold(F.col("obs"), mapped({f"{a}>{b}": f for (a, b), f in moves.items()}, "map<string,bigint>"), mapped(sums, "map<int,bigint>"), F.lit(total))
    return lists.select(key, best["path"].alias("tags"))


def split(df: DataFrame, column: str, method: str, lexicon: DataFrame, options, transitions: DataFrame | None = None) -> DataFrame:
    """df with tokens, the same as the arrow engine gives: typed, merged, and tagged where there are transitions.

    Each distinct text is split once and met again by a 128-bit hash of it, so that any task may be run again. Byte
    offsets are running sums over chunks, so that the work is in proportion to a text's length.
    """
    text, rows = F.col(column), df.drop("tokens")
    rows = rows.withColumn("__key", F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))))
    texts = rows.where(text.isNotNull()).select("__key", text.alias("__text")).dropDuplicates(["__key"])
    chars = F.regexp_extract_all("__text", F.lit("(?s)."), F.lit(0))
    cut = lambda c: F.transform(chunk_pieces(F.col("__text"), options.split_len, options.max_len), lambda p: F.struct(F.array_join(F.slice(c, p["start"] + 1, p["end"] - p["start"]), "").alias("text"), p["delimiter"].alias("delimiter"), p["start"].alias("chars")))
    pieces = texts.select("__key", F.posexplode_outer(let(chars, cut)).alias("__k", "p")).where("p IS NOT NULL").select("__key", "__k", F.struct("__key", "__k").alias("key"), "p.*")
    before = Window.partitionBy("__key").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.select("key", "chars", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("int").alias("bytes"))
    inner, marks = pieces.where("NOT delimiter").select("key", "text"), pieces.where("delimiter").select("key", "text")
    if method == "unigram":
        words = unigram_paths(inner, lexicon, options.total).select("key", "words")
        ends = lambda s, w: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + F.char_length(w))
        tiled = lambda e: F.transform(e, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(e, i - 1)).alias("start"), x.alias("end")))
        spans = words.withColumn("spans", F.aggregate("words", F.array().cast("array<int>"), ends, tiled))
        spans = inner.join(spans.join(_tags(words, lexicon, transitions), "key", "left") if transitions is not None else spans.withColumn("tags", F.lit(None).cast("array<int>")), "key")
    else:
        spans = {"forward": forward_spans, "backward": backward_spans, "full": full_spans}[method](inner, lexicon).withColumn("tags", F.lit(None).cast("array<int>"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"))).cast(_SPANS)
    found = spans.select("key", "text", "spans", "tags").unionByName(marks.select("key", "text", whole.alias("spans"), F.array(F.lit(tags.W)).alias("tags")))
    found = found.join(bases, "key").select("key", "text", "tags", "chars", "bytes", F.posexplode_outer("spans").alias("i", "s")).where("s IS NOT NULL")
    byte = lambda k: F.col("bytes") + F.octet_length(F.substring("text", F.lit(1), k))
    tokens = found.select(
        F.col("key.__key").alias("__key"), F.struct(F.col("key.__k").alias("piece"), "i").alias("k"), byte(F.col("s.start")).alias("start"), byte(F.col("s.end")).alias("end"),
        (F.col("chars") + F.col("s.start")).alias("char_start"), (F.col("chars") + F.col("s.end")).alias("char_end"),
        F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("word"), F.coalesce(F.get("tags", F.col("i")), F.lit(tags.NONE)).alias("pos"),
    )
    tokens = typing.merged(typing.typed(tokens, "__key", options.extended_time), "__key", options.compat)
    item = F.struct("start", "end", "pos", "word")
    lists = tokens.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("t")))), lambda x: x["t"]).alias("tokens"))
    kind = "array<struct<start:int,end:int,pos:int,word:string>>"
    out = rows.join(lists, "__key", "left").drop("__key")
    return out.withColumn("tokens", F.when(text.isNotNull(), F.coalesce(F.col("tokens").cast(kind), F.array().cast(kind))))

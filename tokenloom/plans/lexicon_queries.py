"""Queries of the lexicon, segmentation, tagging, training and evaluation layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import tags
from tokenloom.functions.chars import ALNUM
from tokenloom.operators import evaluation, kernels, native, segment, tagging, training
from tokenloom.operators import lexicon as lex
from tokenloom.plans.registry import query
from tokenloom.plans.text_queries import _PUNCT_SQL, ATOM_SQL, TYPE_SQL, _table
from tokenloom.sources import sinks
from tokenloom.sources import text as sources

TOY = {
    "中华": 5, "中华人民": 1, "中华人民共和国": 8, "人民": 20, "共和国": 9, "简称": 3, "中国": 50, "结婚": 10, "和": 100, "尚未": 5, "和尚": 3, "未": 9, "的": 500,
    "软件": 6, "服务": 8,
}
SENTENCES = ("软件和服务", "中华人民共和国简称中国", "结婚的和尚未结婚的", "卡拉OK和abc", "中国 人民")
_TOY_VALUES = ", ".join(f"('{w}', 'n', {f})" for w, f in TOY.items())
_SENTENCE_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SENTENCES, 1))
_TOY_TOTAL = sum(TOY.values())

#: The lexicon derived from the driver's text: repeated 2 to 4 characters that begin with a non-ASCII one.
DERIVED_SQL = r"""texts AS (SELECT row_number() OVER () AS text_id, text FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)),
letters AS (SELECT text_id, unnest(l) AS c1, generate_subscripts(l, 1) AS i FROM (SELECT text_id, regexp_extract_all(text, '(?s).') AS l FROM texts)),
fours AS (SELECT c1, lead(c1, 1) OVER o AS c2, lead(c1, 2) OVER o AS c3, lead(c1, 3) OVER o AS c4 FROM letters WINDOW o AS (PARTITION BY text_id ORDER BY i)),
grams AS (SELECT unnest([c1 || c2, c1 || c2 || c3, c1 || c2 || c3 || c4]) AS word FROM fours WHERE ord(c1) > 127),
lexicon AS (SELECT word, count(*) AS freq FROM grams WHERE word IS NOT NULL GROUP BY word HAVING count(*) >= 2)"""


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "benchmark").select("text").unionByName(_table(spark, sf_dir, "conversations").select("text"))
    return lex.derived(texts)


def toy(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT word, tag, cast(freq AS bigint) AS freq FROM VALUES {_TOY_VALUES} AS t(word, tag, freq)")


def sentences(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_SENTENCE_VALUES} AS t(key, text)")


@query(f"WITH {DERIVED_SQL} SELECT word, freq FROM lexicon")
def lexicon_derived(spark, sf_dir):
    return derived(spark, sf_dir).select("word", "freq")


# hits: characters i to j of a text that are words and begin outside alnum runs
_HITS_SQL = rf"""{DERIVED_SQL},
chars AS (SELECT * FROM (SELECT conv_id, turn, text, unnest(range(length(text)::BIGINT)) AS i FROM conversations) WHERE ord(substr(text, i + 1, 1)) > 127),
hits AS (SELECT conv_id, turn, i, i + n AS j, freq FROM chars, (VALUES (2), (3), (4)) l(n) JOIN lexicon ON lexicon.word = substr(text, i + 1, n)
         WHERE i + n <= length(text))"""


@query(f"WITH {_HITS_SQL} SELECT conv_id, turn, i::INTEGER AS i, j::INTEGER AS j, freq FROM hits")
def full_split_hits(spark, sf_dir):
    """Candidate spans joined with the lexicon, over whole texts."""
    c = segment.spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select(F.struct("conv_id", "turn").alias("key"), "text")
    return native.char_hits(c, derived(spark, sf_dir)).select("key.*", "i", "j", "freq")


def _letters_sql(table: str, key: str, text: str = "text", word: str = "word") -> str:
    """letters of the texts of a table by a key named item_id: i, whether in an alnum run (a), where its run ends (z), and
    hits, the words from i to j."""
    return rf"""{DERIVED_SQL}, turned AS (SELECT {word} AS word FROM lexicon),
lists AS (SELECT {key} AS item_id, regexp_extract_all({text}, '(?s).') AS l FROM {table}),
singles AS (SELECT item_id, len(l) AS n, unnest(l) AS c1, generate_subscripts(l, 1) - 1 AS i FROM lists),
kinds AS (SELECT *, regexp_matches(c1, '{ALNUM}') AS a, lead(c1, 1) OVER o AS c2, lead(c1, 2) OVER o AS c3, lead(c1, 3) OVER o AS c4 FROM singles WINDOW o AS (PARTITION BY item_id ORDER BY i)),
ends AS (SELECT *, lag(a, 1, false) OVER (PARTITION BY item_id ORDER BY i) AS before,
  coalesce(min(CASE WHEN NOT a THEN i END) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) AS z FROM kinds),
hits AS (SELECT item_id, i, i + length(c.word) AS j FROM (SELECT item_id, i, unnest([c1 || c2, c1 || c2 || c3, c1 || c2 || c3 || c4]) AS word FROM kinds WHERE NOT a) c JOIN turned USING (word)),
best AS (SELECT item_id, i, max(j) AS j FROM hits GROUP BY item_id, i)"""


def _walk_sql(reverse: bool, table: str = "benchmark", key: str = "item_id") -> str:
    """Longest match from the left by a cursor over the next position of each start, over a table by a key named item_id."""
    turned = ("reverse(text)", "reverse(word)") if reverse else ("text", "word")
    span = '(n - z)::INTEGER AS "start", (n - a)::INTEGER AS "end"' if reverse else 'a::INTEGER AS "start", z::INTEGER AS "end"'
    return rf"""WITH RECURSIVE {_letters_sql(table, key, *turned)},
steps AS (SELECT ends.item_id, ends.i, n, CASE WHEN a THEN z ELSE coalesce(best.j, ends.i + 1) END AS j FROM ends LEFT JOIN best USING (item_id, i)),
walk AS (SELECT item_id, n, i AS a, j AS z FROM steps WHERE i = 0 UNION ALL SELECT s.item_id, s.n, s.i, s.j FROM walk JOIN steps s ON s.item_id = walk.item_id AND s.i = walk.z)
SELECT item_id, {span} FROM walk"""


def _spans(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("item_id"), F.explode("spans").alias("s")).select("item_id", "s.*")


def _benchmark(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")


@query(_walk_sql(False))
def forward_max_match(spark, sf_dir):
    return _spans(native.forward_spans(_benchmark(spark, sf_dir), derived(spark, sf_dir)))


@query(_walk_sql(True))
def backward_max_match(spark, sf_dir):
    return _spans(native.backward_spans(_benchmark(spark, sf_dir), derived(spark, sf_dir)))


def _full_sql(table: str = "benchmark", key: str = "item_id") -> str:
    """All words from all starts, runs, and single characters that the last hit does not cover."""
    return rf"""WITH {_letters_sql(table, key)},
last AS (SELECT ends.*, last_value(best.j IGNORE NULLS) OVER (PARTITION BY ends.item_id ORDER BY ends.i ROWS UNBOUNDED PRECEDING) AS last FROM ends LEFT JOIN best USING (item_id, i))
SELECT item_id, i::INTEGER AS "start", j::INTEGER AS "end" FROM hits
UNION ALL SELECT item_id, i::INTEGER, (i + 1)::INTEGER FROM last WHERE NOT a AND coalesce(last, -1) <= i
UNION ALL SELECT item_id, i::INTEGER, z::INTEGER FROM last WHERE a AND NOT before"""


@query(_full_sql())
def full_split(spark, sf_dir):
    return _spans(native.full_spans(_benchmark(spark, sf_dir), derived(spark, sf_dir)))


_TURN = "conv_id || ':' || turn"


def _tokens_sql(spans: str) -> str:
    """Tokens of conversations from their spans: typed by form, runs of equal numbers merged, in bytes."""
    return rf"""WITH spans AS ({spans}), texts AS (SELECT conv_id, turn, {_TURN} AS item_id, text FROM conversations),
t AS (SELECT conv_id, turn, text, "start" AS a, "end" AS z, substr(text, "start" + 1, "end" - "start") AS w,
  row_number() OVER (PARTITION BY item_id ORDER BY "start", "end") AS k FROM spans JOIN texts USING (item_id)),
typed AS (SELECT *, {TYPE_SQL} AS pos FROM (SELECT *, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY k) AS f FROM t)),
marked AS (SELECT *, CASE WHEN pos IN ({tags.MA}, {tags.MC}) AND pos = lag(pos) OVER (PARTITION BY conv_id, turn ORDER BY k) THEN 0 ELSE 1 END AS new FROM typed),
islands AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY k) AS island FROM marked),
tokens AS (SELECT conv_id, turn, island, any_value(text) AS text, arg_min(a, k) AS a, arg_max(z, k) AS z, min(pos) AS pos FROM islands GROUP BY conv_id, turn, island)
SELECT conv_id, turn, (island - 1)::INTEGER AS k, strlen(substr(text, 1, a))::INTEGER AS "start", strlen(substr(text, 1, z))::INTEGER AS "end", pos, substr(text, a + 1, z - a) AS word FROM tokens"""


def _tokens(spark, sf_dir, method: str) -> DataFrame:
    """Tokens of conversations by the Arrow engine, each text one chunk, as SQL can follow the choice only so."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = segment.tokenize(turns, "text", derived(spark, sf_dir), method, options=segment.Options(split_len=1 << 30, max_len=1 << 30))
    return segment.explode_tokens(out, "conv_id", "turn")


@query(_tokens_sql(_walk_sql(False, "conversations", _TURN)))
def forward_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir, "forward")


@query(_tokens_sql(_walk_sql(True, "conversations", _TURN)))
def backward_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir, "backward")


@query(_tokens_sql(_full_sql("conversations", _TURN)))
def full_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir, "full")


_NAMES_SQL = "CASE pos " + " ".join(f"WHEN {i} THEN '{name}'" for name, i in tags.TAG_IDS.items()) + " END"


@query(f"""SELECT conv_id, turn, string_agg(word || '/' || coalesce({_NAMES_SQL}, pos::VARCHAR), ' ' ORDER BY k) AS tagged,
  string_agg('(' || "start" || ',' || "end" || ',' || pos || ',0)', '' ORDER BY k) AS printed, sum("end" - "start")::BIGINT AS n_bytes,
  string_agg('(' || "start" || ',' || "end" || ',' || word || coalesce('/' || {_NAMES_SQL}, '') || ')', '' ORDER BY k) AS shown
FROM ({_tokens_sql(_walk_sql(False, "conversations", _TURN))}) GROUP BY conv_id, turn""")
def token_texts(spark, sf_dir):
    """The printed forms of the tokens of conversations, and their lengths."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    t = F.col("tokens")
    out = segment.forward_split(turns, "text", derived(spark, sf_dir), segment.Options(split_len=1 << 30, max_len=1 << 30)).where(F.size("tokens") > 0)
    lengths = F.aggregate(sinks.token_lengths(t), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("conv_id", "turn", segment.tagged_text(t).alias("tagged"), sinks.formatted_tokens(t).alias("printed"), lengths.alias("n_bytes"), F.array_join(sinks.token_text(t), "").alias("shown"))


def _unigram_sql(table: str, key: str) -> str:
    """The cheapest path of each text: costs of the ends of atoms one after the other, and back along the best starts."""
    return rf"""WITH RECURSIVE {DERIVED_SQL}, total AS (SELECT sum(freq) AS n FROM lexicon),
atoms AS (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS i FROM (SELECT {key} AS item_id, regexp_extract_all(text, '{ATOM_SQL}') AS l FROM {table})),
places AS (SELECT *, sum(length(w)) OVER o - length(w) AS a, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM atoms WINDOW o AS (PARTITION BY item_id ORDER BY i)),
joined AS (SELECT item_id, i, i + 2 AS j, w || w1 AS word FROM places UNION ALL SELECT item_id, i, i + 3, w || w1 || w2 FROM places UNION ALL SELECT item_id, i, i + 4, w || w1 || w2 || w3 FROM places),
edges AS (SELECT item_id, i, i + 1 AS j, 1 AS freq FROM places UNION ALL SELECT item_id, i, j, freq FROM joined JOIN lexicon USING (word)),
ends AS (SELECT item_id, j, list({{'i': i, 'c': floor(-ln((freq + 1) / (total.n + 1)) * {kernels.GRID} + 0.5) / {kernels.GRID}}}) AS es FROM edges, total GROUP BY item_id, j),
sizes AS (SELECT item_id, count(*) AS n FROM atoms GROUP BY item_id),
paths(item_id, j, costs, back) AS (
  SELECT item_id, 0::BIGINT, [0.0::DOUBLE], []::BIGINT[] FROM sizes
  UNION ALL
  SELECT item_id, j, list_append(costs, best.c), list_append(back, best.i) FROM (
    SELECT p.item_id, e.j, costs, back, list_sort(list_transform(es, lambda x: {{'c': costs[x.i + 1] + x.c, 'i': x.i}}))[1] AS best
    FROM paths p JOIN ends e ON e.item_id = p.item_id AND e.j = p.j + 1)),
solved AS (SELECT paths.item_id, n, back FROM paths JOIN sizes ON sizes.item_id = paths.item_id AND j = n),
steps(item_id, a, z, back) AS (SELECT item_id, back[n], n, back FROM solved WHERE n > 0 UNION ALL SELECT item_id, back[a], a, back FROM steps WHERE a > 0)
SELECT s.item_id, p.a::INTEGER AS "start", (q.a + length(q.w))::INTEGER AS "end" FROM steps s JOIN places p ON p.item_id = s.item_id AND p.i = s.a JOIN places q ON q.item_id = s.item_id AND q.i = s.z - 1"""


def _documents_sql(spans: str) -> str:
    """n_tokens and digest of the tokens of documents. Texts are cut into pieces first: at each step the first character
    from byte next_b on that is a delimiter, or before which more than 890 bytes have gathered; spans are those of pieces
    by piece_id."""
    little = lambda x: f"printf('%02x%02x%02x%02x', {x} & 255, ({x} >> 8) & 255, ({x} >> 16) & 255, ({x} >> 24) & 255)"
    return rf"""WITH RECURSIVE singles AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents)),
sized AS (SELECT *, strlen(c) AS w, (sum(strlen(c)) OVER o - strlen(c))::BIGINT AS b, c IN ('。', '，', ' ', chr(10), chr(9)) AS d, lag(strlen(c), 1, 0) OVER o AS w0 FROM singles WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
chars AS (SELECT *, min(CASE WHEN d THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mark FROM sized),
-- the first character from each byte on
from_byte AS (SELECT doc_id, i, mark, unnest(range(CASE WHEN i = 0 THEN 0 ELSE b - w0 + 1 END, b + 1)) AS byte FROM chars),
cuts(doc_id, cut, hard, start_b, next_b) AS (
  SELECT DISTINCT doc_id, NULL::BIGINT, false, 0::BIGINT, 60::BIGINT FROM singles
  UNION ALL
  SELECT k.doc_id, k.i, coalesce(k.i = greatest(x.i, h.i) AND h.i IS NOT NULL, false) AS hard,
    CASE WHEN coalesce(k.i = greatest(x.i, h.i) AND h.i IS NOT NULL, false) THEN k.b ELSE k.b + k.w END, k.b + 60 + k.w
  FROM cuts JOIN from_byte x ON x.doc_id = cuts.doc_id AND x.byte = cuts.next_b LEFT JOIN from_byte h ON h.doc_id = cuts.doc_id AND h.byte = cuts.start_b + 891
  JOIN chars k ON k.doc_id = cuts.doc_id AND k.i = CASE WHEN h.i IS NULL THEN x.mark WHEN x.mark IS NULL THEN greatest(x.i, h.i) ELSE least(x.mark, greatest(x.i, h.i)) END),
begins AS (SELECT doc_id, cut AS i, NOT hard AS alone FROM cuts WHERE cut IS NOT NULL UNION ALL SELECT doc_id, cut + 1, false FROM cuts WHERE cut IS NOT NULL AND NOT hard),
flags AS (SELECT doc_id, i, bool_or(alone) AS alone FROM begins GROUP BY doc_id, i),
parts AS (SELECT chars.*, coalesce(alone, false) AS alone, sum(CASE WHEN flags.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY chars.doc_id ORDER BY chars.i) AS part
  FROM chars LEFT JOIN flags ON flags.doc_id = chars.doc_id AND flags.i = chars.i),
pieces AS (SELECT doc_id, doc_id || ':' || part AS piece_id, part, string_agg(c, '' ORDER BY i) AS text, min(b) AS b, bool_or(alone) AS alone FROM parts GROUP BY doc_id, part),
inner_pieces AS (SELECT piece_id, text FROM pieces WHERE NOT alone),
spans AS (SELECT * FROM ({spans}) UNION ALL SELECT piece_id, 0, 1 FROM pieces WHERE alone),
t AS (SELECT doc_id, b + strlen(substr(text, 1, "start")) AS s, b + strlen(substr(text, 1, "end")) AS z, substr(text, "start" + 1, "end" - "start") AS w, alone,
  row_number() OVER (PARTITION BY doc_id ORDER BY part, "start", "end") AS k FROM spans JOIN pieces ON piece_id = item_id),
formed AS (SELECT *, {TYPE_SQL} AS form FROM (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY k) AS f FROM t)),
typed AS (SELECT *, CASE WHEN form <> {tags.NONE} THEN form WHEN alone THEN {tags.W} ELSE {tags.NONE} END AS pos FROM formed),
marked AS (SELECT *, CASE WHEN pos IN ({tags.MA}, {tags.MC}) AND pos = lag(pos) OVER (PARTITION BY doc_id ORDER BY k) THEN 0 ELSE 1 END AS new FROM typed),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM marked),
tokens AS (SELECT doc_id, island, arg_min(s, k)::BIGINT AS s, arg_max(z, k)::BIGINT AS z, min(pos)::BIGINT AS pos FROM islands GROUP BY doc_id, island),
sums AS (SELECT doc_id, count(*) AS n_tokens, sha256(unhex(string_agg({little("s")} || {little("z")} || {little("pos")}, '' ORDER BY island))) AS digest FROM tokens GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n_tokens, 0) END AS n_tokens, CASE WHEN text IS NOT NULL THEN coalesce(digest, sha256('')) END AS digest FROM documents LEFT JOIN sums USING (doc_id)"""


def _split_documents(spark, sf_dir, method: str, lexicon: DataFrame | None = None, transitions: DataFrame | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return segment.digests(docs, "text", derived(spark, sf_dir) if lexicon is None else lexicon, method, transitions)


@query(_documents_sql(_walk_sql(False, "inner_pieces", "piece_id")))
def forward_documents(spark, sf_dir):
    """Tokens of whole documents, as a digest, by the Arrow engine; tested against the native engine and brute force."""
    return _split_documents(spark, sf_dir, "forward")


@query(_documents_sql(_walk_sql(True, "inner_pieces", "piece_id")))
def backward_documents(spark, sf_dir):
    return _split_documents(spark, sf_dir, "backward")


@query(_documents_sql(_full_sql("inner_pieces", "piece_id")))
def full_documents(spark, sf_dir):
    return _split_documents(spark, sf_dir, "full")


@query(_documents_sql(_unigram_sql("inner_pieces", "piece_id")))
def unigram_documents(spark, sf_dir):
    return _split_documents(spark, sf_dir, "smart")


#: Words of conversations with a tag that depends on their length, role and turn, so that most words have several tags;
#: longer capitalised words within a line are names.
_ANNOTATED_TAGS = ("n", "v", "a", "d", "u", "p", "c")
_ANNOTATED_SQL = f"""annotated AS (SELECT conv_id, turn, k, w, CASE WHEN k > 1 AND strlen(w) > 3 AND regexp_matches(w, '^[A-Z]') THEN 'nr' ELSE ['{"', '".join(_ANNOTATED_TAGS)}'][(length(w) + 2 * (role = 'user')::INTEGER + 3 * (turn % 2 = 1)::INTEGER) % {len(_ANNOTATED_TAGS)} + 1] END AS tag
  FROM (SELECT *, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT *, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') AS l FROM conversations)))"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, line): an annotated corpus of word/tag lines, one a turn of conversations."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))
    shift = F.when(F.col("role") == "user", 2).otherwise(0) + F.when(F.col("turn") % 2 == 1, 3).otherwise(0)
    other = lambda w: F.get(F.array(*map(F.lit, _ANNOTATED_TAGS)), (F.char_length(w) + shift) % len(_ANNOTATED_TAGS))
    tag = lambda w, k: F.when((k > 0) & (F.octet_length(w) > 3) & w.rlike("^[A-Z]"), "nr").otherwise(other(w))
    line = F.array_join(F.transform(words, lambda w, k: F.concat(w, F.lit("/"), tag(w, k))), " ")
    return _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("line_id"), line.alias("line"))


@query(f"WITH {_ANNOTATED_SQL} SELECT w AS word, tag, count(*) AS freq FROM annotated GROUP BY ALL")
def corpus_word_tag(spark, sf_dir):
    """Training over a whole table of annotated lines: words by tag."""
    return training.train(annotated(spark, sf_dir))["lexicon"]


@query(f"""WITH {_ANNOTATED_SQL} SELECT prev, tag AS next, count(*) AS freq FROM (SELECT tag, lag(tag) OVER (PARTITION BY conv_id, turn ORDER BY k) AS prev FROM annotated)
WHERE prev IS NOT NULL GROUP BY ALL""")
def corpus_tag_bigram(spark, sf_dir):
    return training.train(annotated(spark, sf_dir))["transition"]


_ANNOTATED_ROLES_SQL = f"""WITH {_ANNOTATED_SQL}, before AS (SELECT *, lag(tag) OVER (PARTITION BY conv_id, turn ORDER BY k) AS b FROM annotated),
roles AS (SELECT conv_id, turn, k, w, CASE WHEN tag = 'nr' THEN 'S' WHEN b = 'nr' THEN 'E' ELSE 'O' END AS role FROM before)"""


@query(f"""{_ANNOTATED_ROLES_SQL}, c AS (SELECT w, unnest(range(1, length(w)::BIGINT + 1)) AS i FROM roles WHERE role = 'S')
SELECT unit, role, count(*) AS freq FROM (SELECT w AS unit, role FROM roles
  UNION ALL SELECT substr(w, i, 1), CASE WHEN i = 1 THEN 'B' WHEN i = length(w) THEN 'D' ELSE 'C' END FROM c) GROUP BY ALL""")
def corpus_person_roles(spark, sf_dir):
    return training.train(annotated(spark, sf_dir))["person_role"]


@query(f"""{_ANNOTATED_ROLES_SQL}, units AS (  -- all roles in a row: a name's characters, then the name
  SELECT conv_id, turn, k, 1000000 AS i, role FROM roles
  UNION ALL SELECT conv_id, turn, k, i, CASE WHEN i = 1 THEN 'B' WHEN i = n THEN 'D' ELSE 'C' END
  FROM (SELECT conv_id, turn, k, length(w) AS n, unnest(range(1, length(w)::BIGINT + 1)) AS i FROM roles WHERE role = 'S')),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id, turn, i = 1000000 ORDER BY k, i) AS same FROM units),
words AS (SELECT conv_id, turn, k, lag(role) OVER (PARTITION BY conv_id, turn ORDER BY k) AS word FROM roles),
pairs AS (SELECT CASE WHEN i = 1 OR i = 1000000 THEN word ELSE same END AS prev, role AS next FROM p JOIN words USING (conv_id, turn, k))
SELECT prev, next, count(*) AS freq FROM (SELECT * FROM pairs WHERE prev IS NOT NULL UNION ALL SELECT 'D', next FROM pairs WHERE prev = 'S') GROUP BY ALL""")
def corpus_role_bigrams(spark, sf_dir):
    return training.train(annotated(spark, sf_dir))["person_transition"]


@query()
def names_documents(spark, sf_dir):
    """Names in whole documents, by roles learnt from annotated lines; tested against the kernel."""
    trained = training.train(annotated(spark, sf_dir))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tagging.recognize(docs, "text", derived(spark, sf_dir), trained["person_role"], trained["person_transition"])
    return found.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size("names").cast("long").alias("n_names"))


@query("""WITH names(word) AS (SELECT DISTINCT n_name FROM nation), c AS (SELECT word, unnest(range(1, length(word)::BIGINT + 1)) AS i FROM names)
SELECT unit, role, count(*) AS freq FROM (SELECT word AS unit, 'nr' AS role FROM names
  UNION ALL SELECT substr(word, i, 1), CASE WHEN i = 1 THEN 'B' WHEN i = length(word) THEN 'D' ELSE 'C' END FROM c) GROUP BY ALL""")
def train_listed_roles(spark, sf_dir):
    """A list of names, each a name itself and its characters by their place."""
    return training.listed_roles(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")).distinct())


@query(f"""WITH {_ANNOTATED_SQL} SELECT conv_id, turn, string_agg(w, '' ORDER BY k) AS sentence, count(*) AS n_words, string_agg(tag, ' ' ORDER BY k) AS tags FROM annotated GROUP BY conv_id, turn""")
def gold_corpus(spark, sf_dir):
    """What the estimators compare with: sentences, words and tags of annotated lines."""
    gold = training.gold_sentences(training.entities(training.parse_corpus(annotated(spark, sf_dir))))
    return gold.select("line_id.*", "sentence", F.size("words").cast("long").alias("n_words"), F.array_join("tags", " ").alias("tags"))


@query()
def tagging_documents(spark, sf_dir):
    """Tags of whole documents by a model trained on annotated lines, in which most words have several tags."""
    trained = training.train(annotated(spark, sf_dir))
    return _split_documents(spark, sf_dir, "tagging", lex.union(trained["lexicon"], derived(spark, sf_dir)), trained["transition"])


@query()
def nshort_documents(spark, sf_dir):
    """The six cheapest paths of each whole document, in chunks; tested against all paths. Null texts give no rows."""
    held = segment.load(derived(spark, sf_dir))

    def run(frames):
        import hashlib

        import pandas as pd

        for f in frames:
            rows = []
            for i, text in zip(f["key"], f["text"]):
                off = kernels.byte_offsets(text)
                for k, (c, ends) in enumerate(kernels.n_best_text(text, held, 6), 1):
                    at = " ".join(map(str, off[np.array(ends, np.int64)].tolist()))
                    rows.append((i, k, len(ends), round(c, 6), hashlib.sha256(at.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["key", "rank", "n_tokens", "cost", "digest"])

    docs = segment.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("key"), "text")
    return docs.mapInPandas(run, "key string, rank long, n_tokens long, cost double, digest string").select(F.col("key").cast("long").alias("doc_id"), "rank", "n_tokens", "cost", "digest")


_EDGES_SQL = rf"""toy(word, tag, freq) AS (VALUES {_TOY_VALUES}), sentences(key, text) AS (VALUES {_SENTENCE_VALUES}),
atoms AS (SELECT key, unnest(regexp_extract_all(text, '{ATOM_SQL}')) AS w, generate_subscripts(regexp_extract_all(text, '{ATOM_SQL}'), 1) - 1 AS i FROM sentences),
spans AS (SELECT a.key, a.i, b.i + 1 AS j, (SELECT string_agg(c.w, '' ORDER BY c.i) FROM atoms c WHERE c.key = a.key AND c.i BETWEEN a.i AND b.i) AS word
          FROM atoms a JOIN atoms b ON a.key = b.key AND b.i >= a.i),
edges AS (SELECT key, i, j, word, coalesce(freq, 1) AS freq, -ln((coalesce(freq, 1) + 1) / {float(_TOY_TOTAL + 1)}) AS cost FROM spans LEFT JOIN toy USING (word) WHERE freq IS NOT NULL OR j = i + 1)"""


@query(f"WITH {_EDGES_SQL} SELECT key, i::INTEGER AS i, j::INTEGER AS j, word, freq::BIGINT AS freq, round(cost, 6) AS cost FROM edges")
def unigram_edges(spark, sf_dir):
    return native.atom_edges(sentences(spark), toy(spark)).withColumn("cost", F.round("cost", 6))


_PATHS_SQL = rf"""WITH RECURSIVE {_EDGES_SQL},
n AS (SELECT key, max(j) AS n FROM edges GROUP BY key),
paths(key, pos, cost, words, steps) AS (SELECT key, 0::BIGINT, 0.0::DOUBLE, ''::VARCHAR, []::BIGINT[] FROM sentences
  UNION ALL SELECT e.key, e.j, p.cost + e.cost, p.words || '/' || e.word, list_append(p.steps, e.j) FROM paths p JOIN edges e ON e.key = p.key AND e.i = p.pos),
ended AS (SELECT key, cost, words, row_number() OVER (PARTITION BY key ORDER BY cost, steps) AS rank FROM paths JOIN n USING (key) WHERE pos = n)"""


@query(f"{_PATHS_SQL} SELECT key, words AS path FROM ended WHERE rank = 1")
def unigram_path(spark, sf_dir):
    return native.unigram_paths(sentences(spark), toy(spark)).select("key", F.concat(F.lit("/"), F.array_join("words", "/")).alias("path"))


@query(f"{_PATHS_SQL} SELECT key, round(cost, 6) AS cost FROM ended WHERE rank = 1")
def unigram_cost(spark, sf_dir):
    return native.unigram_paths(sentences(spark), toy(spark)).select("key", F.round("cost", 6).alias("cost"))


@query(f"{_PATHS_SQL} SELECT key, rank, words AS path, round(cost, 6) AS cost FROM ended WHERE rank <= 6")
def nshort_path_topn(spark, sf_dir):
    held = segment.load(toy(spark))

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [
                (key, k, "/" + "/".join(text[a:b] for a, b in p), round(c, 6))
                for key, text in zip(f["key"], f["text"]) for k, (c, p) in enumerate(kernels.n_best(text, held, 6), 1)
            ]
            yield pd.DataFrame(rows, columns=["key", "rank", "path", "cost"])

    return sentences(spark).mapInPandas(run, "key int, rank long, path string, cost double")


# tagging fixtures: words, their tags, and counts from tag to tag
EMISSIONS = (("中国", "n", 50), ("中国", "ns", 80), ("人民", "n", 60), ("和", "c", 90), ("和", "p", 30), ("和", "v", 5), ("发展", "v", 40), ("发展", "vn", 45))
MOVES = (("n", "n", 30), ("n", "v", 40), ("ns", "n", 25), ("n", "c", 12), ("c", "n", 15), ("c", "vn", 9), ("v", "n", 33), ("ns", "c", 7), ("p", "n", 11), ("n", "vn", 14), ("n", "p", 6))
TAGGED = ("中国 人民 和 发展", "中国 和 人民", "发展", "和 发展 中国")
_EMISSION_VALUES = ", ".join(f"('{w}', '{t}', {tags.TAG_IDS[t]}, {f})" for w, t, f in EMISSIONS)
_MOVE_VALUES = ", ".join(f"('{a}', '{b}', {tags.TAG_IDS[a]}, {tags.TAG_IDS[b]}, {f})" for a, b, f in MOVES)
_TAGGED_VALUES = ", ".join(f"({i}, {k}, '{w}')" for i, s in enumerate(TAGGED, 1) for k, w in enumerate(s.split()))
_VITERBI_SQL = f"""WITH RECURSIVE e(w, t, g, f) AS (VALUES {_EMISSION_VALUES}), m(a, b, ga, gb, f) AS (VALUES {_MOVE_VALUES}), obs(key, k, w) AS (VALUES {_TAGGED_VALUES}),
s AS (SELECT ga AS g, sum(f) AS n FROM m GROUP BY ga), total AS (SELECT sum(f) AS n FROM e),
cand AS (SELECT key, k, g, f FROM obs JOIN e USING (w)),
paths(key, k, g, cost, tags) AS (
  SELECT key, k, g, -ln((f + 1) / (total.n + 10.0)), g::VARCHAR FROM cand, total WHERE k = 0
  UNION ALL
  SELECT c.key, c.k, c.g, p.cost - ln((coalesce(m.f, 0) + 1) / (coalesce(sp.n, 0) + 10.0)) - ln((c.f + 1) / (coalesce(sc.n, 0) + 10.0)), p.tags || ' ' || c.g
  FROM paths p JOIN cand c ON c.key = p.key AND c.k = p.k + 1 LEFT JOIN m ON m.ga = p.g AND m.gb = c.g LEFT JOIN s sp ON sp.g = p.g LEFT JOIN s sc ON sc.g = c.g),
n AS (SELECT key, max(k) AS n FROM obs GROUP BY key)"""


def _hidden(spark):
    emissions = spark.createDataFrame(list(EMISSIONS), "word string, tag string, freq long")
    return emissions, spark.createDataFrame(list(MOVES), "prev string, next string, freq long")


@query(f"{_VITERBI_SQL} SELECT key, min_by(tags, cost) AS tags, round(min(cost), 6) AS cost FROM paths JOIN n USING (key) WHERE k = n GROUP BY key")
def viterbi_tags(spark, sf_dir):
    """By the fold over observations; the Arrow kernel gives the same (tests)."""
    emissions, moves = _hidden(spark)
    ids = F.create_map(*[F.lit(x) for t, i in tags.TAG_IDS.items() for x in (t, i)])
    words = spark.sql(f"SELECT * FROM VALUES {_TAGGED_VALUES} AS t(key, k, word)")
    cands = emissions.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.element_at(ids, F.col("tag")).alias("tag"), F.col("freq").alias("f")))).alias("o"))
    obs = words.join(F.broadcast(cands), "word").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "o"))), lambda x: x["o"]).alias("obs"))
    move = F.create_map(*[F.lit(x) for a, b, f in MOVES for x in (f"{tags.TAG_IDS[a]}>{tags.TAG_IDS[b]}", f)])
    sums: dict[int, int] = {}
    for a, _, f in MOVES:
        sums[tags.TAG_IDS[a]] = sums.get(tags.TAG_IDS[a], 0) + f
    total = F.create_map(*[F.lit(x) for kv in sums.items() for x in kv])
    best = tagging.viterbi_fold(F.col("obs"), move, total, F.lit(sum(f for *_, f in EMISSIONS)))
    return obs.select("key", best.alias("b")).select("key", F.array_join(F.transform("b.path", lambda x: x.cast("string")), " ").alias("tags"), F.round("b.c", 6).alias("cost"))


_PRIOR_NAMES = ("n", "a", "v", "c", "u", "p")
_PRIOR_VALUES = ", ".join(f"('{t}', {tags.TAG_IDS[t]})" for t in _PRIOR_NAMES)


@query(f"""WITH m(a, b, ga, gb, f) AS (VALUES {_MOVE_VALUES}), p(t, g) AS (VALUES {_PRIOR_VALUES}),
n AS (SELECT p.g, coalesce(sum(f), 0) + 1 AS n FROM p LEFT JOIN m ON m.a = p.t GROUP BY p.g)
SELECT g::BIGINT AS tag_id, (n * 1000 // (SELECT sum(n) FROM n))::BIGINT AS weight FROM n""")
def unknown_prior(spark, sf_dir):
    model = segment.hidden_model(*_hidden(spark))
    return spark.createDataFrame(model.prior, "tag_id long, weight long")


ROLES = ("BCD:王 小 明", "BDO:李 四 说", "OSO:和 张三 说", "BCO:王 小 说", "OBDEBD:叫 王 石 和 李 四", "BB D:王 王 X 石")
_ROLE_ROWS = [(i, r.replace(" ", ""), w.split()) for i, (r, w) in enumerate((x.split(":") for x in ROLES), 1)]
_ROLE_VALUES = ", ".join(f"({i}, {k}, '{w}', '{r}')" for i, roles, words in _ROLE_ROWS for k, (w, r) in enumerate(zip(words, roles)))


@query(f"""WITH t(key, k, w, r) AS (VALUES {_ROLE_VALUES}),
s AS (SELECT key, string_agg(r, '' ORDER BY k) AS roles FROM t GROUP BY key),
m AS (SELECT key, unnest(regexp_extract_all(roles, 'BC*D|S|.')) AS run, generate_subscripts(regexp_extract_all(roles, 'BC*D|S|.'), 1) AS i FROM s),
p AS (SELECT *, sum(length(run)) OVER (PARTITION BY key ORDER BY i) - length(run) AS a FROM m)
SELECT p.key, string_agg(t.w, '' ORDER BY t.k) AS name FROM p JOIN t ON t.key = p.key AND t.k >= a AND t.k < a + length(run)
WHERE length(run) > 1 OR run = 'S' GROUP BY p.key, p.i""")
def ner_entities(spark, sf_dir):
    rows = []
    for i, roles, words in _ROLE_ROWS:
        at, tokens = 0, []
        for w in words:
            tokens.append((at, at + len(w.encode()), tags.NONE, w))
            at += len(w.encode())
        rows.append((i, tokens, list(roles)))
    df = spark.createDataFrame(rows, f"key int, tokens {segment.TOKENS}, roles array<string>")
    return df.select("key", F.explode(tagging.entities(F.col("tokens"), F.col("roles"), tags.TAG_IDS["nr"])).alias("e")).select("key", F.col("e.word").alias("name"))


# training over plain annotated lines; composites and errors are in the tests
CORPUS = ("中央/n 电视台/n 报道/v 。/w", "王/nr 小明/nr 说/v 中国/ns 和/c 人民/n", "他/r 说/v 王小明/nr 来/v", "他/r 和/c 王/nr 说/v", "人民/n 说/v 中国/ns", "李小龙/nr 来/v 了/u", "中国/ns 人民/n", "坏行", "和/p 人民/n")
_CORPUS_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(CORPUS, 1))
# a pair of names, a surname of 3 bytes and a given name of up to 6, is one entity with two parts
_TRAIN_SQL = f"""lines(line_id, line) AS (VALUES {_CORPUS_VALUES}),
tok AS (SELECT line_id, unnest(string_split(line, ' ')) AS t, generate_subscripts(string_split(line, ' '), 1) AS k FROM lines WHERE line LIKE '%/%'),
raw AS (SELECT line_id, k, split_part(t, '/', 1) AS word, split_part(t, '/', 2) AS tag FROM tok),
pair AS (SELECT *, tag = 'nr' AND lead(tag) OVER w = 'nr' AND strlen(word) = 3 AND strlen(lead(word) OVER w) <= 6 AS joins, lead(word) OVER w AS following FROM raw WINDOW w AS (PARTITION BY line_id ORDER BY k)),
whole AS (SELECT line_id, k, CASE WHEN joins THEN word || following ELSE word END AS word, tag, joins FROM (SELECT *, lag(joins) OVER (PARTITION BY line_id ORDER BY k) AS second FROM pair) WHERE NOT coalesce(second, false))"""


def _trained(spark):
    lines = spark.sql(f"SELECT * FROM VALUES {_CORPUS_VALUES} AS t(line_id, line)")
    return training.parse_corpus(lines)


@query(f"""WITH {_TRAIN_SQL} SELECT word, tag, count(*) AS freq FROM (SELECT word, tag FROM raw UNION ALL SELECT word, tag FROM whole WHERE joins) GROUP BY ALL""")
def train_word_tag(spark, sf_dir):
    return training.word_tags(training.entities(_trained(spark)))


@query(f"""WITH {_TRAIN_SQL} SELECT prev, tag AS next, count(*) AS freq FROM (SELECT line_id, tag, lag(tag) OVER (PARTITION BY line_id ORDER BY k) AS prev FROM raw) WHERE prev IS NOT NULL GROUP BY ALL""")
def train_tag_bigram(spark, sf_dir):
    return training.tag_bigrams(training.entities(_trained(spark)))


@query(f"WITH {_TRAIN_SQL} SELECT count(*) + (SELECT count(*) FROM whole WHERE joins) AS words_total, count(*) + (SELECT count(*) FROM whole WHERE joins) AS pos_total FROM raw")
def train_totals(spark, sf_dir):
    return training.corpus_totals(training.entities(_trained(spark)))


@query(f"WITH {_TRAIN_SQL} SELECT reverse(word) AS word, count(*) AS freq FROM (SELECT word FROM raw UNION ALL SELECT word FROM whole WHERE joins) GROUP BY ALL")
def train_inverse(spark, sf_dir):
    return training.inverse_words(training.entities(_trained(spark)))


@query(f"""WITH {_TRAIN_SQL}, ch AS (SELECT word, unnest(range(1, length(word)::BIGINT + 1)) AS i FROM whole WHERE tag = 'nr')
SELECT unit, role, count(*) AS freq FROM (
  SELECT word AS unit, CASE WHEN tag = 'nr' THEN 'S' WHEN before = 'nr' THEN 'E' ELSE 'O' END AS role FROM (SELECT *, lag(tag) OVER (PARTITION BY line_id ORDER BY k) AS before FROM whole)
  UNION ALL SELECT substr(word, i, 1), CASE WHEN i = 1 THEN 'B' WHEN i = length(word) THEN 'D' ELSE 'C' END FROM ch) GROUP BY ALL""")
def train_person_roles(spark, sf_dir):
    return training.person_roles(training.entities(_trained(spark)))


@query(f"WITH {_TRAIN_SQL} SELECT CASE WHEN length(word) = 2 THEN 'BD' ELSE 'BCD' END AS shape, count(*) AS freq FROM whole WHERE tag = 'nr' GROUP BY ALL")
def name_shapes(spark, sf_dir):
    return training.name_shapes(training.entities(_trained(spark)))


@query(f"""WITH {_TRAIN_SQL}, r AS (SELECT role, lag(role) OVER (PARTITION BY line_id ORDER BY k) AS prev FROM (
  SELECT *, CASE WHEN tag = 'nr' THEN 'S' WHEN lag(tag) OVER (PARTITION BY line_id ORDER BY k) = 'nr' THEN 'E' ELSE 'O' END AS role FROM whole)),
ch AS (SELECT length(word) AS n, unnest(range(1, length(word)::BIGINT)) AS i FROM whole WHERE tag = 'nr' AND length(word) > 1)
SELECT prev, next, count(*) AS freq FROM (SELECT prev, role AS next FROM r WHERE prev IS NOT NULL UNION ALL SELECT 'D', role FROM r WHERE prev = 'S'
  UNION ALL SELECT prev, 'B' FROM r WHERE prev IS NOT NULL AND role = 'S' UNION ALL SELECT 'D', 'B' FROM r WHERE prev = 'S' AND role = 'S'
  UNION ALL SELECT CASE WHEN i = 1 THEN 'B' ELSE 'C' END, CASE WHEN i = n - 1 THEN 'D' ELSE 'C' END FROM ch) GROUP BY ALL""")
def train_role_bigrams(spark, sf_dir):
    return training.role_bigrams(training.entities(_trained(spark)))


@query(f"SELECT count(*) AS n_lines, count(*) FILTER (line NOT LIKE '%/%') AS n_errors FROM (VALUES {_CORPUS_VALUES}) t(line_id, line)")
def train_errors(spark, sf_dir):
    return training.parse_errors(_trained(spark))


# lexicon tables: words of part names and types with their counts
_PART_SQL = """lexicon AS (SELECT word, tag, count(*) AS freq FROM (
  SELECT unnest(string_split(p_type, ' ')) AS word, 'n' AS tag FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')), 'a' FROM part) GROUP BY ALL)"""


def _parts(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    words = lambda c, t: part.select(F.explode(F.split(c, " ")).alias("word"), F.lit(t).alias("tag"))
    return words("p_type", "n").unionByName(words("p_name", "a")).groupBy("word", "tag").agg(F.count("*").alias("freq"))


@query(f"WITH {_PART_SQL}, toy(word, tag, freq) AS (VALUES {_TOY_VALUES}) SELECT word, tag, sum(freq)::BIGINT AS freq FROM (SELECT * FROM lexicon UNION ALL SELECT * FROM toy UNION ALL SELECT * FROM toy) GROUP BY ALL")
def lexicon_union(spark, sf_dir):
    return lex.union(_parts(spark, sf_dir), toy(spark), toy(spark))


USER_LINES = ("中国\\t5\\tns", "新词\\t7\\tn", "无频", "两栏\\t3", "另词\\tx\\tv", "结婚\\t9\\tv")
_USER_VALUES = ", ".join(f"('{x}')" for x in USER_LINES)


@query(f"""WITH toy(word, tag, freq) AS (VALUES {_TOY_VALUES}), p AS (SELECT string_split(replace(x, '\\t', chr(9)), chr(9)) AS l FROM (VALUES {_USER_VALUES}) t(x)),
u AS (SELECT l[1] AS word, CASE WHEN len(l) = 3 THEN l[3] END AS tag, coalesce(try_cast(nullif(regexp_extract(coalesce(l[2], '1'), '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0) AS freq FROM p)
SELECT word, tag, CASE WHEN tag IS NOT NULL THEN freq END AS freq FROM u WHERE word NOT IN (SELECT word FROM toy)
UNION ALL SELECT word, tag, freq FROM toy""")
def user_dict_anti(spark, sf_dir):
    lines = spark.createDataFrame([(x.replace("\\t", "\t"),) for x in USER_LINES], "value string")
    return sources.load_user_dictionary(toy(spark), sources.user_entries(lines))


@query(f"""WITH toy(word, tag, freq) AS (VALUES {_TOY_VALUES}), l(word) AS (VALUES ('中国'), ('未知'), ('中国'), ('和'))
SELECT word, tag, freq::BIGINT AS freq FROM toy UNION ALL SELECT word, 'UDF', count(*) FROM l WHERE word IN (SELECT word FROM toy) GROUP BY word""")
def udf_semi(spark, sf_dir):
    return sources.load_word_list(toy(spark), spark.createDataFrame([("中国",), ("未知",), ("中国",), ("和",)], "word string"), "UDF")


@query(f"WITH {_PART_SQL} SELECT word, (sum(freq) OVER ())::BIGINT AS total, tag, freq FROM lexicon WHERE word = (SELECT max(word) FROM lexicon WHERE tag = 'n')")
def lexicon_lookup(spark, sf_dir):
    words = _parts(spark, sf_dir)
    last = words.where("tag = 'n'").agg(F.max("word")).first()[0]
    return lex.lookup(words, last)


@query(f"WITH {_PART_SQL} SELECT p AS word FROM (VALUES ('ST'), ('STA'), ('ZZ'), (''), ('al'), ('almond')) t(p) WHERE EXISTS (SELECT 1 FROM lexicon WHERE starts_with(word, p))")
def lexicon_prefix(spark, sf_dir):
    return lex.has_prefix(spark.createDataFrame([("ST",), ("STA",), ("ZZ",), ("",), ("al",), ("almond",)], "word string"), _parts(spark, sf_dir))


@query(f"WITH {_PART_SQL}, ids AS (SELECT word, row_number() OVER (ORDER BY first, word) + 200 AS word_id FROM (SELECT word, min(freq) AS first FROM lexicon GROUP BY word)) SELECT word, word_id FROM ids")
def lexicon_ids(spark, sf_dir):
    return lex.with_ids(_parts(spark, sf_dir), "freq", after=200)


@query(f"""WITH {_PART_SQL}, ids AS (SELECT word, row_number() OVER (ORDER BY min(freq), word) AS word_id FROM lexicon GROUP BY word)
SELECT w.word, coalesce(word_id, -1) AS word_id FROM (SELECT n_name AS word FROM nation UNION ALL SELECT DISTINCT word FROM lexicon WHERE tag = 'n') w LEFT JOIN ids ON ids.word = w.word""")
def lexicon_lookup_ids(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    words = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")).unionByName(parts.where("tag = 'n'").select("word").distinct())
    return lex.lookup_ids(words, lex.with_ids(parts, "freq"))


@query(f"WITH {_PART_SQL} SELECT word FROM lexicon WHERE word IN (SELECT unnest(string_split(p_name, ' ')) FROM part WHERE p_size < 5)")
def lexicon_exist(spark, sf_dir):
    words = _table(spark, sf_dir, "part").where("p_size < 5").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return _parts(spark, sf_dir).select("word").join(lex.exist(words, _parts(spark, sf_dir)), "word", "left_semi")


@query(f"WITH {_PART_SQL} SELECT word, tag, freq FROM lexicon WHERE word NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part WHERE p_size < 5)")
def lexicon_remove(spark, sf_dir):
    words = _table(spark, sf_dir, "part").where("p_size < 5").select(F.explode(F.split("p_name", " ")).alias("word"))
    return lex.remove(_parts(spark, sf_dir), words)


@query(f"WITH {_PART_SQL}, toy(word, tag, freq) AS (VALUES {_TOY_VALUES}) SELECT word, tag, freq::BIGINT AS freq FROM toy UNION ALL SELECT word, min(tag), 1::BIGINT FROM lexicon GROUP BY word")
def lexicon_add_if_absent(spark, sf_dir):
    new = _parts(spark, sf_dir).groupBy("word").agg(F.min("tag").alias("tag")).withColumn("freq", F.lit(1).cast("long"))
    return lex.add_if_absent(toy(spark), new.unionByName(toy(spark).withColumn("freq", F.lit(9).cast("long"))))


@query(f"WITH {_PART_SQL} SELECT word, tag, (freq * CASE WHEN tag = 'n' THEN 2 ELSE 1 END)::BIGINT AS freq FROM lexicon")
def lexicon_add_attribute(spark, sf_dir):
    words = _parts(spark, sf_dir)
    return lex.add_attribute(words, words.where("tag = 'n'").unionByName(spark.createDataFrame([("unknown", "n", 5)], lex.SCHEMA)))


@query(f"WITH {_PART_SQL} SELECT w.word, w.tag, coalesce(l.freq, 0)::BIGINT AS freq FROM (SELECT DISTINCT word, t AS tag FROM lexicon, (VALUES ('n'), ('a'), ('v')) x(t)) w LEFT JOIN lexicon l USING (word, tag)")
def attribute_frequency(spark, sf_dir):
    words = _parts(spark, sf_dir)
    asked = words.select("word").distinct().select("word", F.explode(F.array(*map(F.lit, "nav"))).alias("tag"))
    return lex.attribute_frequency(asked, words)


@query(f"WITH {_PART_SQL} SELECT word, sum(freq)::BIGINT AS freq FROM lexicon GROUP BY word")
def word_frequency(spark, sf_dir):
    return lex.word_frequency(_parts(spark, sf_dir))


_MOVES_SQL = "moves(prev, next, freq) AS (VALUES ('BRASS', 'STEEL', 7), ('BRASS', 'BRASS', 2), ('zz', 'BRASS', 1))"


def _moves(spark):
    return spark.createDataFrame([("BRASS", "STEEL", 7), ("BRASS", "BRASS", 2), ("zz", "BRASS", 1)], "prev string, next string, freq long")


@query(f"WITH {_PART_SQL}, {_MOVES_SQL} SELECT word, sum(freq)::BIGINT AS freq FROM (SELECT word, freq FROM lexicon UNION ALL SELECT prev, freq FROM moves) GROUP BY word")
def compat_frequency(spark, sf_dir):
    return lex.compat_frequency(_parts(spark, sf_dir), _moves(spark))


@query(f"""WITH {_PART_SQL}, ids AS (SELECT word, row_number() OVER (ORDER BY min(freq), word) AS word_id, sum(freq) AS total,
  string_agg(tag || ':' || freq, ' ' ORDER BY tag) AS info FROM lexicon GROUP BY word), asked AS (SELECT n_name AS word FROM nation UNION ALL SELECT word FROM ids)
SELECT a.word, coalesce(ids.word || '(id=' || word_id || ', total=' || total || ') ' || info || ' ', 'not found in dict') AS answer FROM asked a LEFT JOIN ids ON ids.word = a.word""")
def lexicon_answers(spark, sf_dir):
    """What the lookup tool says of words."""
    parts = _parts(spark, sf_dir)
    asked = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")).unionByName(parts.select("word").distinct())
    return lex.lookup_text(parts, lex.with_ids(parts, "freq"), asked)


@query(f"""WITH {_PART_SQL}, more AS (SELECT word, 'n' AS tag, 1::BIGINT AS freq FROM lexicon WHERE tag = 'a' UNION ALL SELECT 'unknown', 'n', 1)
SELECT word, tag, freq FROM lexicon WHERE (word, tag) NOT IN (SELECT word, tag FROM more) UNION ALL SELECT word, tag, freq FROM more WHERE word <> 'unknown'""")
def lexicon_set_attribute(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    more = parts.where("tag = 'a'").select("word", F.lit("n").alias("tag"), F.lit(1).cast("long").alias("freq"))
    return lex.set_attribute(parts, more.unionByName(spark.createDataFrame([("unknown", "n", 1)], lex.SCHEMA)))


@query(f"WITH {_PART_SQL} SELECT word, CASE WHEN tag = 'n' THEN tag END AS tag, CASE WHEN tag = 'n' THEN freq END AS freq FROM lexicon")
def lexicon_remove_attribute(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return lex.remove_attribute(parts, parts.where("tag = 'a'"))


@query(f"WITH {_PART_SQL} SELECT sum(freq)::BIGINT AS total FROM lexicon")
def lexicon_totals(spark, sf_dir):
    return lex.totals(_parts(spark, sf_dir))


@query(f"""WITH {_PART_SQL} SELECT word, string_agg(tag || ':' || f, ',' ORDER BY tag) AS info FROM (SELECT word, tag, sum(f)::BIGINT AS f FROM (
  SELECT word, tag, freq AS f FROM lexicon UNION ALL SELECT word, 'n', freq FROM lexicon WHERE tag = 'a') GROUP BY ALL) GROUP BY word""")
def freq_merge(spark, sf_dir):
    words = _parts(spark, sf_dir)
    a, b = lex.frequency_map(words), lex.frequency_map(words.where("tag = 'a'").withColumn("tag", F.lit("n"))).withColumnRenamed("info", "more")
    both = a.join(b, "word", "left").select("word", F.when(F.col("more").isNull(), F.col("info")).otherwise(lex.merge_info(F.col("info"), F.col("more"))).alias("info"))
    return both.select("word", F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("info"))


# evaluation: atoms against blank-separated words, per benchmark item
_PRED_SQL = rf"pred AS (SELECT item_id, unnest(regexp_extract_all(text, '{ATOM_SQL}')) AS word FROM benchmark), gold AS (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark)"


def _pred_gold(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    pred = b.select("item_id", F.explode(F.regexp_extract_all("text", F.lit(f"(?s){ALNUM}+|."), F.lit(0))).alias("word"))
    return pred, b.select("item_id", F.explode(F.split("text", " ")).alias("word"))


@query(f"""WITH {_PRED_SQL}, p AS (SELECT item_id, word, count(*) AS n FROM pred WHERE word NOT IN ({_PUNCT_SQL}) GROUP BY ALL), g AS (SELECT item_id, word, count(*) AS n FROM gold WHERE word NOT IN ({_PUNCT_SQL}) GROUP BY ALL),
c AS (SELECT (SELECT sum(least(p.n, g.n)) FROM p JOIN g USING (item_id, word)) AS hits, (SELECT sum(n) FROM p) AS n_pred, (SELECT sum(n) FROM g) AS n_gold),
s AS (SELECT *, hits / (n_pred + 1e-7) AS precision, hits / (n_gold + 1e-7) AS recall FROM c)
SELECT hits::BIGINT AS hits, n_pred::BIGINT AS n_pred, n_gold::BIGINT AS n_gold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-7), 6) AS f1 FROM s""")
def eval_prf(spark, sf_dir):
    out = evaluation.segmentation_scores(*_pred_gold(spark, sf_dir), key="item_id")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {_PRED_SQL} SELECT item_id, word, count(*) AS n FROM (SELECT * FROM pred INTERSECT ALL SELECT * FROM gold) GROUP BY ALL")
def bag_intersection(spark, sf_dir):
    return evaluation.bag_intersection(*_pred_gold(spark, sf_dir), ["item_id", "word"])


@query(f"WITH {_PRED_SQL} SELECT * FROM pred UNION ALL SELECT * FROM gold")
def bag_union(spark, sf_dir):
    return evaluation.bag_union(*_pred_gold(spark, sf_dir))


@query(f"WITH {_PRED_SQL} SELECT * FROM pred EXCEPT ALL SELECT * FROM gold")
def bag_except(spark, sf_dir):
    return evaluation.bag_except(*_pred_gold(spark, sf_dir))


@query("""WITH t AS (SELECT c_custkey, c_mktsegment AS g, CASE WHEN c_acctbal > 5000 THEN 'BUILDING' ELSE c_mktsegment END AS p FROM customer)
SELECT count(*) AS n, count(*) FILTER (p = g) AS hits, round(count(*) FILTER (p = g) / (count(*) + 1e-7), 6) AS accuracy FROM t""")
def eval_tagger_accuracy(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("k", F.lit(0))
    gold = c.select(F.col("c_custkey").alias("line_id"), "k", F.col("c_mktsegment").alias("tag"))
    pred = c.select(F.col("c_custkey").alias("line_id"), "k", F.when(F.col("c_acctbal") > 5000, "BUILDING").otherwise(F.col("c_mktsegment")).alias("tag"))
    return evaluation.tagger_scores(pred, gold).withColumn("accuracy", F.round("accuracy", 6))


_TAG_LINES = ("w 25", "#x 0", "n 100", "# phone", "nr 108", "", "v 103")
_TAG_VALUES = ", ".join(f"('{x}')" for x in _TAG_LINES)


@query(f"SELECT split_part(x, ' ', 1) AS tag, split_part(x, ' ', 2)::INTEGER AS tag_id FROM (VALUES {_TAG_VALUES}) t(x) WHERE x NOT LIKE '#%' AND x LIKE '% %'")
def tag_table(spark, sf_dir):
    return sources.tag_table(spark.createDataFrame([(x,) for x in _TAG_LINES], "value string"))


_CONF = ((1, "# comment"), (2, "A=1"), (3, " B = two "), (4, "A=3"), (5, ""), (6, "C=x=y"), (7, "IS_ON=TRUE"))
_CONF_VALUES = ", ".join(f"({i}, '{x}')" for i, x in _CONF)


@query(f"""SELECT key, arg_max(value, i) AS value, coalesce(arg_max(value, i) IN ('true', 'TRUE'), false) AS is_true FROM (
  SELECT i, trim(substr(trim(x), 1, strpos(trim(x), '=') - 1)) AS key, trim(substr(trim(x), strpos(trim(x), '=') + 1)) AS value FROM (VALUES {_CONF_VALUES}) t(i, x)
  WHERE trim(x) NOT LIKE '#%' AND trim(x) LIKE '%=%') GROUP BY key""")
def settings(spark, sf_dir):
    out = sources.settings(spark.createDataFrame(list(_CONF), "i int, value string"), order_by="i")
    return out.withColumn("is_true", sources.setting_bool(F.col("value")))


@query("SELECT c AS word, 'w' AS tag, (count(*) * 10000)::BIGINT AS freq FROM (SELECT unnest(string_split('。，、。！', '')) AS c) GROUP BY c")
def delimiter_seed(spark, sf_dir):
    return sources.delimiter_seed(spark, "。，、。！")


@query(f"""WITH RECURSIVE toy(word) AS (SELECT word FROM (VALUES {_TOY_VALUES}) t(word, tag, freq)), s(key, text) AS (VALUES {_SENTENCE_VALUES}),
walk(key, rest, words) AS (SELECT key, text, []::VARCHAR[] FROM s UNION ALL
  SELECT key, substr(rest, 1, length(rest) - n), list_prepend(right(rest, n), words) FROM (
    SELECT key, rest, words, CASE WHEN regexp_matches(rest, '{ALNUM}$') THEN length(regexp_extract(rest, '{ALNUM}+$'))
      ELSE coalesce((SELECT max(length(word)) FROM toy WHERE length(word) > 1 AND ends_with(rest, word)), 1) END AS n FROM walk WHERE rest <> ''))
SELECT key, array_to_string(words, chr(10)) AS response FROM walk WHERE rest = ''""")
def responses(spark, sf_dir):
    """What the service answers: words by backward maximum match, one a line."""
    return sinks.responses(sentences(spark), toy(spark), "text").select("key", "response")


@query(rf"""WITH a AS (SELECT key, regexp_extract_all(text, '{ATOM_SQL}') AS l FROM (VALUES (1, 'ab 1.5 é'), (2, 'x'), (3, '二十 www.abc.com')) t(key, text)),
t AS (SELECT key, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS k FROM a),
o AS (SELECT *, (sum(strlen(w)) OVER (PARTITION BY key ORDER BY k))::INTEGER AS z FROM t),
m AS (SELECT key, k, w, z, CASE WHEN w IN ('二', '十') THEN 'mc' WHEN w = '1.5' THEN 'ma' WHEN w = 'www.abc.com' THEN 'url' WHEN regexp_matches(w, '^[a-z]') THEN 'nx' ELSE 'word' END AS nature FROM o),
g AS (SELECT key, CASE WHEN nature = 'mc' THEN 0 ELSE k END AS k, string_agg(w, '' ORDER BY m.k) AS term, max(z) AS z, any_value(nature) AS nature FROM m GROUP BY 1, 2)
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY k) - 1)::INTEGER AS k, term, (z - strlen(term))::INTEGER AS "start", z AS "end", nature, 1 AS increment FROM g""")
def token_stream_rows(spark, sf_dir):
    texts = spark.createDataFrame([(1, "ab 1.5 é"), (2, "x"), (3, "二十 www.abc.com")], "key int, text string")
    return segment.token_stream(segment.forward_split(texts, "text", toy(spark)), "key")

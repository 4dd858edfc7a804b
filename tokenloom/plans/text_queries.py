"""Queries of the character, token and typing layer over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import chars, tags
from tokenloom.operators import native, typing
from tokenloom.operators.segment import atoms, spread
from tokenloom.plans.registry import query
from tokenloom.sources import text as sources

ATOM_SQL = r"(?s)[#%&+\-./0-9:=>?@A-Z\\_a-z]+|."
NUM_SQL, ENG_SQL = r"^[+\-.0-9]+$", r"^[#%&+\-./:=>?@A-Z\\_a-z]+$"
#: The typing rules as a CASE over w, with the following token in f.
TYPE_SQL = rf"""CASE
  WHEN regexp_matches(w, '{NUM_SQL}') THEN CASE
    WHEN strlen(w) = 11 AND w[1] = '1' AND w[2] BETWEEN '3' AND '8' THEN {tags.MP}
    WHEN strlen(w) = 12 AND (w[4] = '-' OR w[5] = '-') THEN {tags.MP}
    WHEN strlen(w) = 10 AND w[5] = '-' AND w[8] = '-' AND w[6] <= '1' AND w[9] <= '3' THEN {tags.T}
    WHEN strlen(w) = 9 AND w[5] = '-' AND (w[7] = '-' AND w[8] <= '3' OR w[8] = '-' AND w[6] <= '3') THEN {tags.T}
    WHEN strlen(w) <= 4 AND f IN ('年', '月', '日', '时', '分', '秒', '点') THEN {tags.T}
    ELSE {tags.MA} END
  WHEN regexp_matches(w, '{ENG_SQL}') THEN
    CASE WHEN strlen(w) > 5 AND regexp_matches(w, '^(http:/|www\.|mail\.|ftp://)|\.(com|net|cn|org)$') THEN {tags.URL} ELSE {tags.NX} END
  WHEN regexp_matches(w, '^[{chars.NUMERALS}]+$') THEN {tags.MC}
  ELSE {tags.NONE} END"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _atom_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(atoms(F.col(text))).alias("k", "word"))


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '{ATOM_SQL}')) AS n_atoms,
  len(list_distinct(regexp_extract_all(text, '{ATOM_SQL}'))) AS n_kinds FROM documents WHERE text IS NOT NULL""")
def atoms_tokenize(spark, sf_dir):
    a = atoms(F.col("text"))
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL").select("doc_id", F.size(a).cast("long").alias("n_atoms"), F.size(F.array_distinct(a)).cast("long").alias("n_kinds"))


@query(rf"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{ATOM_SQL}')) AS w FROM documents) GROUP BY w")
def atom_frequency(spark, sf_dir):
    return _atom_rows(_table(spark, sf_dir, "documents"), "text").groupBy("word").agg(F.count("*").alias("n"))


@query(rf"""WITH a AS (SELECT conv_id, turn, regexp_extract_all(text, '{ATOM_SQL}') AS l FROM conversations),
t AS (SELECT conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS k FROM a)
SELECT conv_id, turn, k::INTEGER AS k, word,
  (sum(strlen(word)) OVER w - strlen(word))::BIGINT AS byte_start, (sum(strlen(word)) OVER w)::BIGINT AS byte_end, (sum(length(word)) OVER w - length(word))::BIGINT AS char_start
FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k)""")
def atom_offsets_bytes(spark, sf_dir):
    """Offsets by running sums within a text."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "turn").orderBy("k")
    rows = _atom_rows(_table(spark, sf_dir, "conversations"), "text", "conv_id", "turn")
    ends = F.sum(F.octet_length("word")).over(w)
    return rows.select("conv_id", "turn", "k", "word", (ends - F.octet_length("word")).alias("byte_start"), ends.alias("byte_end"), (F.sum(F.char_length("word")).over(w) - F.char_length("word")).alias("char_start"))


@query(rf"""SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_code_points, sum(strlen(text))::BIGINT AS n_bytes,
  sum(len(regexp_extract_all(text, '{ATOM_SQL}')))::BIGINT AS n_atoms FROM documents GROUP BY lang""")
def chars_per_lang(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.char_length("text")).alias("n_code_points"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.size(atoms(F.col("text")))).alias("n_atoms")
    )


def _typed_sql(source: str) -> str:
    return f"""SELECT *, {TYPE_SQL} AS pos FROM ({source})"""


@query(f"""SELECT lang, pos, count(*) AS n FROM ({_typed_sql(rf"SELECT lang, unnest(regexp_extract_all(text, '{ATOM_SQL}')) AS w, NULL::VARCHAR AS f FROM documents")}) GROUP BY lang, pos""")
def token_typing(spark, sf_dir):
    """Types of all atoms; without units of time in the text, no token needs its successor. Each distinct atom is typed once."""
    docs = spread(_table(spark, sf_dir, "documents").select("lang", "text"))
    kinds = _atom_rows(docs, "text", "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return kinds.withColumn("pos", typing.type_of(F.col("word"))).groupBy("lang", "pos").agg(F.sum("n").alias("n"))


def _tokens_of(kind: int, table: str, column: str):
    return f"""SELECT w AS word, count(*) AS n FROM ({_typed_sql(rf"SELECT unnest(regexp_extract_all({column}, '{ATOM_SQL}')) AS w, NULL::VARCHAR AS f FROM {table}")}) WHERE pos = {kind} GROUP BY w"""


def _typed_words(spark, sf_dir, table, column, kind):
    rows = _atom_rows(spread(_table(spark, sf_dir, table).select(column)), column).groupBy("word").agg(F.count("*").alias("n"))
    return rows.where(typing.type_of(F.col("word")) == kind)


@query(_tokens_of(tags.URL, "pages", "html"))
def url_tokens(spark, sf_dir):
    return _typed_words(spark, sf_dir, "pages", "html", tags.URL)


@query(_tokens_of(tags.MA, "conversations", "text"))
def number_tokens(spark, sf_dir):
    return _typed_words(spark, sf_dir, "conversations", "text", tags.MA)


@query(_tokens_of(tags.NX, "conversations", "text"))
def foreign_tokens(spark, sf_dir):
    return _typed_words(spark, sf_dir, "conversations", "text", tags.NX)


TYPED = (
    "13812345678", "010-12345678", "2015-03-17", "2015-3-17", "2015-12-1", "2015/03/17", "18:21:19", "3.14", ".", "-", "二十", "http://a.com", "www.sina.com.cn",
    "www.163.com", "abc", "C++", "百", "é", "中国", "12345678901", "2015-13-17", "www.a", "a.org",
)
_TYPED_VALUES = ", ".join(f"('{w}')" for w in TYPED)


@query(f"SELECT w AS word, pos FROM ({_typed_sql(f'SELECT w, NULL::VARCHAR AS f FROM (VALUES {_TYPED_VALUES}) t(w)')})")
def phone_date_typing(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM VALUES {_TYPED_VALUES} AS t(word)")
    return rows.select("word", typing.type_of(F.col("word")).alias("pos"))


SEQUENCES = {1: "2015|年|3|月|17|日", 2: "二|十|三|个|3|.|14", 3: "12345|年|18:21|点|8|点", 4: "三|百|abc|五", 5: "12|34|56"}
_SEQUENCE_VALUES = ", ".join(f"({key}, {k}, '{w}')" for key, s in SEQUENCES.items() for k, w in enumerate(s.split("|")))
_SEQUENCE_SQL = _typed_sql(f"SELECT key, k, w, lead(w) OVER (PARTITION BY key ORDER BY k) AS f FROM (VALUES {_SEQUENCE_VALUES}) t(key, k, w)")


def _sequences(spark):
    return typing.typed(spark.sql(f"SELECT * FROM VALUES {_SEQUENCE_VALUES} AS t(key, k, word)"))


@query(f"SELECT key, k, w AS word, pos FROM ({_SEQUENCE_SQL})")
def year_lookahead(spark, sf_dir):
    return _sequences(spark)


@query(f"""WITH t AS ({_SEQUENCE_SQL}),
i AS (SELECT *, sum(CASE WHEN pos IN ({tags.MA}, {tags.MC}) AND pos = before THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY k) AS island
      FROM (SELECT *, lag(pos) OVER (PARTITION BY key ORDER BY k) AS before FROM t))
SELECT key, min(k) AS k, string_agg(w, '' ORDER BY k) AS word, min(pos) AS pos FROM i GROUP BY key, island""")
def chinese_number_merge(spark, sf_dir):
    return typing.merged(_sequences(spark))


@query(f"""SELECT CASE WHEN regexp_full_match(w, '[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?|[0-9]{{4}}/[01][0-9]/[0-3][0-9]') AND pos <> {tags.MA} THEN {tags.T} ELSE pos END AS pos, count(*) AS n
FROM ({_typed_sql(rf"SELECT unnest(regexp_extract_all(props || ' ' || strftime(ts, '%H:%M:%S') || ' ' || strftime(ts, '%Y/%m/%d'), '{ATOM_SQL}')) AS w, NULL::VARCHAR AS f FROM events")}) GROUP BY 1""")
def extended_times(spark, sf_dir):
    """Types of the atoms of events' records, clock times and slash dates among them."""
    e = _table(spark, sf_dir, "events")
    text = F.concat_ws(" ", "props", F.date_format("ts", "HH:mm:ss"), F.date_format("ts", "yyyy/MM/dd"))
    kinds = _atom_rows(e.select(text.alias("text")), "text").groupBy("word").agg(F.count("*").alias("n"))
    return kinds.groupBy(typing.type_of(F.col("word"), extended_time=True).alias("pos")).agg(F.sum("n").alias("n"))


@query("""SELECT p_partkey, string_split(p_type, ' ')[1] AS first_piece, len(string_split(p_name, 'al')) AS n_pieces, substr(p_name, 1, 7) AS beginning, upper(p_name) AS upcase,
  regexp_full_match(p_name, '[ \t]+') AS blank FROM part""")
def string_pieces(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.get(chars.split_mark(F.col("p_type"), " ", 2), F.lit(0)).alias("first_piece"), F.size(chars.split_mark(F.col("p_name"), "al")).cast("long").alias("n_pieces"),
        chars.truncated(F.col("p_name"), 7).alias("beginning"), chars.upcase(F.col("p_name")).alias("upcase"), chars.is_whitespace(F.col("p_name")).alias("blank"),
    )


_PUNCT_SQL = ", ".join(f"'{c}'" for c in chars.PUNCTUATION)


@query(rf"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{ATOM_SQL}')) AS w FROM documents) WHERE w NOT IN ({_PUNCT_SQL}) GROUP BY doc_id")
def punct_filter(spark, sf_dir):
    return _atom_rows(_table(spark, sf_dir, "documents"), "text", "doc_id").where(~chars.is_punctuation(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, k::INTEGER AS k, trim(line, ' ' || chr(10) || chr(9) || chr(13)) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)
WHERE length(trim(line, ' ' || chr(10) || chr(9) || chr(13))) > 0""")
def trim_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return sources.trimmed_lines(lines, "line")


@query(r"""SELECT page_id, unnest(CASE WHEN url = '' THEN [''] ELSE regexp_extract_all(url, '[^/:?#&=]+') END) AS part FROM pages""")
def split_any(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(chars.split_any(F.col("url"), "/:?#&=")).alias("part"))


@query("SELECT item_id, array_to_string(list_reverse(regexp_extract_all(text, '(?s).')), '') AS turned FROM benchmark")
def reverse_text(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", chars.reverse_text(F.col("text")).alias("turned"))


ENCODED = ("a+b", "%E4%B8%AD+a", "plain", "%41%42", "1%2B1", "", "a%20b%C3%A9")
_ENCODED_VALUES = ", ".join(f"('{w}')" for w in ENCODED)


@query(f"SELECT x AS encoded, url_decode(replace(x, '+', ' ')) AS decoded FROM (VALUES {_ENCODED_VALUES}) t(x)")
def url_decode(spark, sf_dir):
    return spark.sql(f"SELECT * FROM VALUES {_ENCODED_VALUES} AS t(encoded)").select("encoded", chars.url_decode(F.col("encoded")).alias("decoded"))


@query("""SELECT page_id, starts_with(url, 'https:') AS secure, ends_with(url, '/') AS folder, substr(url, 9, 2) = 'm.' AS mobile, starts_with('https://example', substr(url, 1, 8)) AS prefix FROM pages""")
def starts_ends_with(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", chars.starts_with(url, F.lit("https:")).alias("secure"), chars.ends_with(url, F.lit("/")).alias("folder"), chars.starts_with(url, F.lit("m."), 8).alias("mobile"),
        chars.is_prefix_token(F.lit("https://example"), F.substring("url", 1, 8)).alias("prefix"),
    )


@query("SELECT w AS ch, strlen(w) AS n_bytes, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS w FROM documents) GROUP BY ALL")
def utf8_len(spark, sf_dir):
    c = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("ch"))
    return c.groupBy("ch").agg(F.count("*").alias("n")).withColumn("n_bytes", chars.char_bytes(F.col("ch")).cast("long"))


@query(r"""SELECT item_id, length(substr(text, 3, 20)) AS code_points, strlen(substr(text, 1, 20)) AS bytes_20, regexp_extract(text, '^[#%&+\-./:=>?@A-Z\\_a-z]*') AS english,
  regexp_extract(text, '^[+\-.0-9]*') AS number, regexp_extract(text, '^[#%&+\-./0-9:=>?@A-Z\\_a-z]*') AS alnum, regexp_matches(text, '^[A-Za-z]*$') AS alphabetic,
  CASE WHEN regexp_matches(text, '^[+\-.0-9]') THEN 'MA' WHEN regexp_matches(text, '^[#%&+\-./:=>?@A-Z\\_a-z]') THEN 'NX' END AS kind FROM benchmark""")
def run_prefixes(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "benchmark").select(
        "item_id", chars.code_points(t, 2, 22).cast("long").alias("code_points"), chars.byte_offset(t, F.lit(20)).cast("long").alias("bytes_20"), chars.english_run(t).alias("english"),
        chars.number_run(t).alias("number"), chars.alnum_run(t).alias("alnum"), chars.is_alphabetic(t).alias("alphabetic"), chars.run_kind(t).alias("kind"),
    )


@query(r"""SELECT page_id, replace(url, '\', '/') AS inner_path, CASE WHEN ends_with(url, '/') THEN url ELSE url || '/' END AS folder,
  CASE WHEN ends_with(url, '/') THEN url ELSE url || '/' END || page_id AS combined FROM pages""")
def path_helpers(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", chars.inner_path(u).alias("inner_path"), chars.ensure_dir(u).alias("folder"), chars.combine_path(u, F.col("page_id").cast("string")).alias("combined")
    )


@query(rf"""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{ATOM_SQL}')) AS w FROM documents)
WHERE w <> ' ' GROUP BY w ORDER BY n DESC, w LIMIT 20""")
def top_k_words(spark, sf_dir):
    """The 20 most frequent tokens: a report, so the limit is the query."""
    return atom_frequency(spark, sf_dir).where("word <> ' '").orderBy(F.desc("n"), "word").limit(20)


_CHUNK_SQL = r"""WITH RECURSIVE c AS (
  SELECT id, i, w, strlen(w) AS l, sum(strlen(w)) OVER (PARTITION BY id ORDER BY i) - strlen(w) AS b, w IN ('。', '，', ' ', chr(10), chr(9)) AS d
  FROM (SELECT item_id AS id, unnest(regexp_extract_all(text, '(?s).')) AS w, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) - 1 AS i FROM benchmark)
), r(id, s, si, cur, step, a, z, delimiter) AS (
  SELECT item_id, 0::HUGEINT, 0::BIGINT, 60::HUGEINT, 0, 0::BIGINT, 0::BIGINT, false FROM benchmark
  UNION ALL
  SELECT id, CASE WHEN hard THEN b ELSE b + l END, CASE WHEN hard THEN i ELSE i + 1 END, b + 60 + l, step + 1, si, i, NOT hard FROM (
    SELECT r.id, r.si, r.step, c.i, c.b, c.l, c.b - r.s > 890 AS hard, row_number() OVER (PARTITION BY r.id ORDER BY c.i) AS k
    FROM r JOIN c ON c.id = r.id AND c.b >= r.cur AND (c.d OR c.b - r.s > 890)) WHERE k = 1
), last AS (SELECT id, max(si) AS si FROM r GROUP BY id), n AS (SELECT id, count(*) AS n FROM c GROUP BY id)
SELECT id AS item_id, a::INTEGER AS "start", z::INTEGER AS "end", false AS delimiter FROM r WHERE step > 0 AND z > a
UNION ALL SELECT id, z::INTEGER, (z + 1)::INTEGER, true FROM r WHERE step > 0 AND delimiter
UNION ALL SELECT id, si::INTEGER, n::INTEGER, false FROM last JOIN n USING (id) WHERE si < n"""


@query(_CHUNK_SQL)
def chunk_sentences(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.explode(native.chunk_pieces(F.col("text"))).alias("p")).select("item_id", "p.*")


REQUESTS = (
    r"POST /?ip=1.2.3.4&key=k HTTP/1.1\r\nReferer: r\r\n\r\ndata=%E4%B8%AD+a", r"GET /x?ip=5.6.7.8 HTTP/1.1\r\n\r\n", r"POST / HTTP/1.0\r\nHost: h\r\n\r\ndata=abc+def&z=1",
    r"POST /seg HTTP/1.1\r\n\r\n",
)
_REQUEST_SQL = ", ".join("({}, '{}')".format(i, r) for i, r in enumerate(REQUESTS))


@query(rf"""WITH q AS (SELECT id, replace(x, '\r\n', chr(13) || chr(10)) AS raw FROM (VALUES {_REQUEST_SQL}) t(id, x))
SELECT id, nullif(regexp_extract(raw, '^(GET|POST) ', 1), '') AS method, nullif(regexp_extract(raw, '^\S+ ([^? ]*)', 1), '') AS path,
  nullif(regexp_extract(raw, '^\S+ [^? ]*\?(?:[^ ]*&)?ip=([^& ]*)', 1), '') AS ip, nullif(regexp_extract(raw, '(?i)\r\nReferer: *([^\r\n]*)', 1), '') AS referer,
  CASE WHEN raw LIKE 'POST %' THEN nullif(url_decode(replace(regexp_extract(raw, '(?s)\r\n\r\n(?:.*&)?data=([^&]*)', 1), '+', ' ')), '') END AS data FROM q""")
def http_requests(spark, sf_dir):
    rows = [(i, r.replace("\\r\\n", "\r\n")) for i, r in enumerate(REQUESTS)]
    return sources.requests(spark.createDataFrame(rows, "id int, raw string")).select("id", "method", "path", "ip", "referer", "data")

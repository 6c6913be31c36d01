"""Cleaning, normalising, token filters and display forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import present, text
from tessera.plans import corpus_build as CB
from tessera.queries import views as V
from tessera.registry import query

_FIXTURE = [
    (1, "本科及以上", "1-3年", "上海市", "20000", "10000", "  由 你 \t\t 负责  http://a.cn/x 微信扫码关注我 ok\r\n\n\n\nend "),
    (2, "大学本科", "3-5年", "广东省", None, "8000", "该数据由某站整理。岗位职责：1、开发 2、测试"),
    (3, "高中及以上", "5-10年", "恩施自治州", "5000", "9000", "（来源：网络）任职要求:熟悉Python"),
    (4, "中专", "7年", "其他", "面议", "-1", ""),
    (5, "硕士/本科", "一年以上", None, "1e4", "1e4", None),
    (6, "", "无经验", "  ", "0", "0", "   "),
    (7, "MBA", "15年", "香港特别行政区", "12000", "3000", "more data 样 例 数据 网 x"),
    (8, None, "负责大型系统设计与开发以及其他若干工作内容", "不限", "  7000 ", "", "a b　c"),
    (9, "学士学位", "半年经验", "苏州", "9000.5", "9000.4", "plain"),
]
#: The names of the collecting site in the fixture.
BRANDS = ("样例数据网", "样例数据")
_SCHEMA = "k int, education string, experience string, city string, low string, high string, body string"


def _lit(v) -> str:
    if not isinstance(v, str):
        return "NULL" if v is None else str(v)
    safe = v.replace("'", "''")
    for raw, code in (("\t", 9), ("\n", 10), ("\r", 13)):
        safe = safe.replace(raw, f"' || chr({code}) || '")
    return f"('{safe}')"


_ROWS = f"fx(k, education, experience, city, low, high, body) AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in _FIXTURE)}))"


def _fixture(spark) -> DataFrame:
    return spark.createDataFrame(_FIXTURE, _SCHEMA)


def _clean_sql(column: str) -> str:
    out = reduce(lambda c, s: f"regexp_replace({c}, '{s[0]}', '{s[1]}', 'g')", text.cleaning_steps(BRANDS), column)
    return f"CASE WHEN {column} IS NULL OR trim({column}) = '' THEN '' ELSE {out} END"


@query("clean_text", f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text"), BRANDS).alias("cleaned"))


#: Worked by hand from the statement of the rules.
_CLEANED = [(1, "由 你 负责 我 ok\n\nend"), (2, "岗位职责：1、开发 2、测试"), (3, "任职要求:熟悉Python"), (4, ""), (5, ""), (6, ""), (7, "more data x"), (8, "a b c"), (9, "plain")]


@query("clean_text_cases", f"SELECT CAST(k AS INTEGER) AS k, cleaned FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in _CLEANED)}) AS t(k, cleaned)")
def clean_text_cases(spark, sf_dir) -> DataFrame:
    return _fixture(spark).select("k", text.clean_text(F.col("body"), BRANDS).alias("cleaned"))


_EDU = "CASE WHEN education IS NULL OR trim(education) = '' THEN '学历不限' " + " ".join(f"WHEN regexp_matches(education, '{p}') THEN '{v}'" for v, p in (("博士", "博士"), ("硕士", "硕士"), ("本科", "本科|学士"), ("大专", "大专|专科"), ("中技/中专", "中专|中技|中职|技校|职高"), ("高中", "高中"), ("初中及以下", "初中"))) + " ELSE '学历不限' END"
_EXP_GROUPS = " ".join(
    f"WHEN regexp_matches(experience, '{p}') THEN '{v}'"
    for v, p in (("经验不限", "不限|应届毕业生|应届生|无需|无经验|无工作经验"), ("1年以下", "1年以内|1年以下"), ("1年及以上", "1年|一年及以上|一年以上"), ("2年及以上", "2年|两年及以上|两年以上"), ("3年及以上", "3年|三年及以上|三年以上"), ("5年及以上", "5-7年|5年|五年及以上|五年以上"), ("8年及以上", "5-10年|8年|八年以上"), ("10年及以上", "10年|十年以上"))
)
_YEARS = r"TRY_CAST(regexp_extract(experience, '([0-9]+)\s*年', 1) AS INTEGER)"
_EXP = f"""CASE WHEN experience IS NULL OR trim(experience) = '' THEN '经验不限' {_EXP_GROUPS}
WHEN contains(experience, '年') OR contains(experience, '经验') THEN CASE WHEN {_YEARS} IS NULL THEN '经验不限' WHEN {_YEARS} <= 1 THEN '1年及以上' WHEN {_YEARS} <= 2 THEN '2年及以上' WHEN {_YEARS} <= 3 THEN '3年及以上' WHEN {_YEARS} <= 5 THEN '5年及以上' WHEN {_YEARS} <= 8 THEN '8年及以上' ELSE '10年及以上' END
WHEN length(trim(experience)) > 15 THEN '经验不限' ELSE trim(experience) END"""
_STRIPPED = "regexp_replace(trim(city), '(市|地区|自治州|特别行政区)$', '')"
_CITY = f"CASE WHEN city IS NULL OR trim(city) = '' OR {_STRIPPED} IN ('', '其他', '其它', '不限', '全国') THEN '全国' WHEN {_STRIPPED} = '广东省' THEN '广东' ELSE {_STRIPPED} END"


@query("normalize_education", f"WITH {_ROWS} SELECT k, {_EDU} AS education FROM fx")
def normalize_education(spark, sf_dir) -> DataFrame:
    return _fixture(spark).select("k", text.normalize_education(F.col("education")).alias("education"))


@query("normalize_experience", f"WITH {_ROWS} SELECT k, {_EXP} AS experience FROM fx")
def normalize_experience(spark, sf_dir) -> DataFrame:
    return _fixture(spark).select("k", text.normalize_experience(F.col("experience")).alias("experience"))


@query("normalize_city", f"WITH {_ROWS} SELECT k, {_CITY} AS city FROM fx")
def normalize_city(spark, sf_dir) -> DataFrame:
    return _fixture(spark).select("k", text.normalize_city(F.col("city")).alias("city"))


@query("salary_swap", f"WITH {_ROWS}, p AS (SELECT k, TRY_CAST(trim(low) AS DOUBLE) AS a, TRY_CAST(trim(high) AS DOUBLE) AS b FROM fx) SELECT k, CASE WHEN a > b THEN b ELSE a END AS low, CASE WHEN a > b THEN a ELSE b END AS high FROM p")
def salary_swap(spark, sf_dir) -> DataFrame:
    low, high = text.ordered_pair(text.parse_number(F.col("low")), text.parse_number(F.col("high")))
    return _fixture(spark).select("k", low.alias("low"), high.alias("high"))


@query("default_fill", f"WITH {_ROWS} SELECT k, CASE WHEN city IS NULL OR trim(city) = '' THEN '全国' ELSE city END AS city FROM fx")
def default_fill(spark, sf_dir) -> DataFrame:
    return _fixture(spark).select("k", text.fill_default(F.col("city"), "全国").alias("city"))


@query("clean_corpus", f"WITH {_ROWS}, c AS (SELECT k, {_clean_sql('body')} AS body, {_clean_sql('education')} AS education, {_clean_sql('city')} AS city FROM fx) SELECT k, body, {_EDU} AS education, {_CITY} AS city FROM c WHERE trim(body) <> ''")
def clean_corpus(spark, sf_dir) -> DataFrame:
    return CB.clean(_fixture(spark).select("k", "body", "education", "city"), BRANDS)


@query("normalised_tokens", f"WITH {V.TOK} SELECT doc_id, array_to_string(title_tokens, '/') AS title_tokens, len(body_tokens) AS n_tokens FROM tok")
def normalised_tokens(spark, sf_dir) -> DataFrame:
    t = V.token_rows(spark, sf_dir)
    return t.select("doc_id", text.encode_tokens(F.col("title_tokens")).alias("title_tokens"), F.size("body_tokens").cast("long").alias("n_tokens"))


@query("token_codec", "SELECT p_partkey, list_filter(list_transform(string_split(p_name || '// ' || p_brand || '/', '/'), lambda w: trim(w)), lambda w: w <> '')[2] AS second, len(list_filter(list_transform(string_split(p_name || '// ' || p_brand || '/', '/'), lambda w: trim(w)), lambda w: w <> '')) AS n FROM part")
def token_codec(spark, sf_dir) -> DataFrame:
    words = text.decode_tokens(F.concat("p_name", F.lit("// "), "p_brand", F.lit("/")))
    return V.table(spark, sf_dir, "part").select("p_partkey", words.getItem(1).alias("second"), F.size(words).cast("long").alias("n"))


_PUNCT = text.char_class(text.KEYWORD_MARKS)
_TOKEN = "'开发' 'Python' 'c' 'C+' '3.5%' '2024' 'ab' 'abc' '的人' '上市' '进口' '数据。' '工程师' 'x' '与会'".replace("'", "").split()


@query("token_filter", f"SELECT w, length(w) >= 2 AND NOT regexp_matches(w, '{_PUNCT}') AND NOT regexp_matches(w, '^[0-9]+(\\.[0-9]+)?%?$') AND NOT regexp_matches(w, '^[A-Za-z]{{1,2}}$') AND NOT (length(w) = 2 AND regexp_matches(w, '[{text.FRAGMENT}]') AND w NOT IN ({', '.join(repr(x) for x in text.WHOLE)})) AS valid FROM (SELECT unnest([{', '.join(repr(x) for x in _TOKEN)}]) AS w)")
def token_filter(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(w,) for w in _TOKEN], "w string").select("w", text.valid_token(F.col("w")).alias("valid"))


_RULES = {"index": "length(w) >= 2 AND w NOT IN ('the', 'and')", "matrix": "NOT regexp_matches(w, '[，。；：、（）【】\\-;:,.!?0-9]') AND w <> ''", "classify": "NOT regexp_matches(w, '[，。；：、（）【】\\-;:,.!?]') AND w <> ''", "cluster": "NOT regexp_matches(w, '[，。；：、（）【】\\-;:,.!?0-9]') AND length(w) >= 2 AND w NOT IN ('the', 'and')"}


@query("lexical_filters", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(list_filter(string_split(lower(text), ' '), lambda w: {r})) AS n FROM documents" for k, r in _RULES.items()))
def lexical_filters(spark, sf_dir) -> DataFrame:
    words = V.table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    counts = F.array(*(F.struct(F.lit(k).alias("kind"), F.size(text.lexical_filter(F.col("w"), k, ["the", "and"])).cast("long").alias("n")) for k in _RULES))
    return words.select("doc_id", F.explode(counts).alias("x")).select("doc_id", "x.*")


_ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("escape_html", f"SELECT page_id, {_ESCAPE.format('html')} AS escaped FROM pages")
def escape_html(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", present.escape_html(F.col("html")).alias("escaped"))


@query("highlight", f"SELECT doc_id, regexp_replace({_ESCAPE.format('text')}, '(?i)that', '<mark class=\"highlight\">that</mark>', 'g') AS marked FROM documents")
def highlight(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", present.highlight(F.col("text"), ["that"]).alias("marked"))


@query("snippet", f"SELECT doc_id, {V.snippet_sql('text', 100)} AS snippet FROM (SELECT doc_id, text, position('with' IN lower(text)) AS place FROM documents)")
def snippet(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", present.snippet(F.col("text"), ["with"], 100, mark=False).alias("snippet"))


@query("display_forms", "SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN CAST(CAST(round_even(o_totalprice / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) END AS money, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || 'k-' || CAST(CAST(floor(o_totalprice * 1.5 / 1000) AS BIGINT) AS VARCHAR) || 'k' AS salary, printf('%.2f%%', 100.0 * o_orderkey / 17000) AS pct, format('{:,}', o_orderkey) AS grouped FROM orders")
def display_forms(spark, sf_dir) -> DataFrame:
    price = F.col("o_totalprice")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", present.money(price).alias("money"), present.salary_text(price, price * 1.5).alias("salary"), present.percent(F.col("o_orderkey"), F.lit(17000)).alias("pct"), present.grouped(F.col("o_orderkey")).alias("grouped"))


_HEADS = "|".join(present.HEADERS)
_DESCRIBED = "'说明。岗位职责：1、' || p_name || ' 2.' || p_brand || '！任职要求:' || p_type || chr(13) || chr(10) || '三、' || p_size || ' 福利待遇 12)a' || chr(10) || chr(9) || '公司简介 x'"


@query("description_lines", rf"""WITH cut AS (SELECT p_partkey, regexp_replace(regexp_replace({_DESCRIBED}, '([。！？\s])([0-9]+[.、)）])', '\1' || chr(10) || '\2', 'g'), '([。！？\s])((?:{_HEADS})[：:])', '\1' || chr(10) || '\2', 'g') AS t FROM part),
lined AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(t, '\r\n?|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM cut)
SELECT p_partkey, CAST(place AS INTEGER) AS pos, CASE WHEN regexp_matches(line, '^(?:{_HEADS})') THEN 'head' WHEN regexp_matches(line, '^[0-9一二三四五六七八九十]+[.、)）]') THEN 'item' ELSE 'para' END AS kind, line FROM (SELECT p_partkey, unnest(l) AS line, unnest(range(len(l))) AS place FROM lined)""")
def description_lines(spark, sf_dir) -> DataFrame:
    body = F.expr("concat('说明。岗位职责：1、', p_name, ' 2.', p_brand, '！任职要求:', p_type, char(13), char(10), '三、', p_size, ' 福利待遇 12)a', char(10), char(9), '公司简介 x')")
    rows = V.table(spark, sf_dir, "part").select("p_partkey", F.posexplode(present.description_lines(body)).alias("pos", "x"))
    return rows.select("p_partkey", "pos", "x.kind", "x.line")


@query("company_matches", "SELECT doc_id, source, contains(lower('src1 that'), lower(source)) OR contains(lower(source), lower('src1 that')) AS matches FROM documents")
def company_matches(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", "source", text.matches_either_way(F.col("source"), F.lit("src1 that")).alias("matches"))

"""Segmentation over texts made of the part table, and query understanding over literal texts, whose SQL states results worked by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.chinese import with_digits
from tessera.operators import search as S
from tessera.operators import segment as G
from tessera.operators import tokenise as TK
from tessera.plans import query_parser as Q
from tessera.queries import views as V
from tessera.registry import query

_WORDS = ["研究", "研究生", "生命", "命", "起源", "数据", "分析", "数据分析", "师", "分析师", "工程", "工程师", "程师", "产品"]
_METHODS = {"forward": G.forward, "backward": G.backward, "bidirectional": G.bidirectional, "fewest": G.fewest}
#: Which words stand in the line of a part: (factor, offset) of its key.
_PLACES = ((7, 3), (5, 1), (3, 2), (1, 0))


def lines(spark, sf_dir) -> DataFrame:
    """k, gold (joined by /), line: four words of the list for each part, and a word of Latin letters after every third."""
    words = F.array(*map(F.lit, _WORDS))
    own = F.array(*(F.get(words, ((F.col("p_partkey") * a + b) % len(_WORDS)).cast("int")) for a, b in _PLACES), F.when(F.col("p_partkey") % 3 == 0, "Python3"))
    gold = F.array_compact(own)
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(gold, "/").alias("gold"), F.array_join(gold, "").alias("line"))


_LIST = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
_MADE = f"""word_list AS (SELECT {_LIST} AS w),
made AS (SELECT p_partkey AS k, list_filter([{', '.join(f'w[(p_partkey * {a} + {b}) % {len(_WORDS)} + 1]' for a, b in _PLACES)}, CASE WHEN p_partkey % 3 = 0 THEN 'Python3' END], lambda x: x IS NOT NULL) AS gold FROM part, word_list),
han AS (SELECT k, regexp_extract(array_to_string(gold, ''), '^[一-龥]+') AS line, CASE WHEN k % 3 = 0 THEN ['Python3'] ELSE CAST([] AS VARCHAR[]) END AS rest, w FROM made, word_list)"""
_LONGEST = max(map(len, _WORDS))
_SPLIT = f"""{_MADE},
fwd(k, line, w, pos, words) AS (SELECT k, line, w, 1, CAST([] AS VARCHAR[]) FROM han UNION ALL
  SELECT k, line, w, pos + n, list_append(words, substring(line, pos, n)) FROM (SELECT *, CAST(coalesce(list_max(list_transform(list_filter(w, lambda x: starts_with(substring(line, pos), x)), lambda x: length(x))), 1) AS INTEGER) AS n FROM fwd WHERE pos <= length(line))),
bwd(k, line, w, pos, words) AS (SELECT k, line, w, CAST(length(line) AS INTEGER), CAST([] AS VARCHAR[]) FROM han UNION ALL
  SELECT k, line, w, pos - n, list_prepend(substring(line, pos - n + 1, n), words) FROM (SELECT *, CAST(coalesce(list_max(list_transform(list_filter(w, lambda x: ends_with(substring(line, 1, pos), x)), lambda x: length(x))), 1) AS INTEGER) AS n FROM bwd WHERE pos > 0)),
dp(k, line, w, j, best, cut) AS (SELECT k, line, w, 0, [0], [0] FROM han UNION ALL
  SELECT k, line, w, j + 1, list_append(best, CAST(least_ + 1 AS INTEGER)), list_append(cut, CAST(list_filter(c, lambda i: best[i + 1] = least_)[1] AS INTEGER))
  FROM (SELECT *, list_min(list_transform(c, lambda i: best[i + 1])) AS least_ FROM (SELECT *, list_filter(range(greatest(0, j + 1 - {_LONGEST}), j + 1), lambda i: j + 1 - i = 1 OR list_contains(w, substring(line, CAST(i + 1 AS BIGINT), CAST(j + 1 - i AS BIGINT)))) AS c FROM dp WHERE j < length(line)))),
few(k, line, cut, j, words) AS (SELECT k, line, cut, j, CAST([] AS VARCHAR[]) FROM dp WHERE j = length(line) UNION ALL
  SELECT k, line, cut, cut[j + 1], list_prepend(substring(line, cut[j + 1] + 1, j - cut[j + 1]), words) FROM few WHERE j > 0),
four AS (SELECT f.k, f.words AS f, b.words AS b, m.words AS m FROM fwd f JOIN bwd b USING (k) JOIN few m USING (k) WHERE f.pos > length(f.line) AND b.pos = 0 AND m.j = 0),
cost AS (SELECT *, (len(f), len(list_filter(f, lambda x: length(x) = 1))) < (len(b), len(list_filter(b, lambda x: length(x) = 1))) AS forwards FROM four),
split AS (SELECT k, method, list_concat(words, rest) AS words FROM (SELECT k, 'forward' AS method, f AS words FROM cost UNION ALL SELECT k, 'backward', b FROM cost UNION ALL SELECT k, 'bidirectional', CASE WHEN forwards THEN f ELSE b END FROM cost UNION ALL SELECT k, 'fewest', m FROM cost) JOIN han USING (k))"""


def splits(spark, sf_dir) -> DataFrame:
    """k, gold, method, test (joined by /) of every line under every dictionary method."""
    made = lines(spark, sf_dir)
    for name, method in _METHODS.items():
        made = G.segment(made, {"line": name}, G.by_dictionary(method, set(_WORDS)))
    rows = F.array(*(F.struct(F.lit(name).alias("method"), text.encode_tokens(F.col(name)).alias("test")) for name in _METHODS))
    return made.select("k", "gold", F.explode(rows).alias("x")).select("k", "gold", "x.*")


_GOLD = [(1, "研究/生命/的/起源/"), (2, "生命/起源/"), (3, "研究/2/年/")]
_GOLD_SQL = "gold(line_no, gold) AS (SELECT * FROM (VALUES (1, '研究/生命/的/起源/'), (2, '生命/起源/'), (3, '研究/2/年/')))"
_HAN_WORDS = f"{_GOLD_SQL}, w AS (SELECT line_no AS line, list_filter(string_split(gold, '/'), lambda x: regexp_matches(x, '^[一-龥]+$')) AS words FROM gold)"


def _gold(spark) -> DataFrame:
    return spark.createDataFrame(_GOLD, "line_no int, gold string")


@query("segment_by_dictionary", f"WITH RECURSIVE {_SPLIT} SELECT k, method, array_to_string(words, '/') AS words FROM split")
def segment_by_dictionary(spark, sf_dir) -> DataFrame:
    return splits(spark, sf_dir).select("k", "method", F.col("test").alias("words"))


@query("segment_by_models")
def segment_by_models(spark, sf_dir) -> DataFrame:
    """HMM, bigram and linear-chain models trained on the gold lines."""
    gold = _gold(spark)
    lines = [[w for w in g.split("/") if w] for _, g in _GOLD]
    models = {"hmm": G.Hmm(*G.tag_counts(gold)), "bigram": G.Bigram(G.gold_words(gold)), "chain": G.Chain(lines)}
    out = None
    for name, model in models.items():
        rows = G.segment(gold.select(F.lit(name).alias("method"), "line_no", text.restore_raw(F.col("gold")).alias("line")), {"line": "t"}, model).select("method", "line_no", text.encode_tokens(F.col("t")).alias("words"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("gold_dictionary", f"WITH {_GOLD_SQL} SELECT DISTINCT word FROM (SELECT unnest(string_split(gold, '/')) AS word FROM gold) WHERE word <> '' AND NOT regexp_matches(word, '^[0-9]+(\\.[0-9]+)?%?$')")
def gold_dictionary(spark, sf_dir) -> DataFrame:
    return G.dictionary(_gold(spark))


_TAGS = "list_reduce(list_transform(words, lambda x: CASE WHEN length(x) = 1 THEN ['S'] WHEN length(x) = 2 THEN ['B', 'E'] ELSE ['B', 'I', 'E'] END), lambda a, b: list_concat(a, b))"


@query("bies_tags", f"WITH {_HAN_WORDS} SELECT line, array_to_string({_TAGS}, '') AS tags FROM w")
def bies_tags(spark, sf_dir) -> DataFrame:
    words = F.filter(text.decode_tokens(F.col("gold")), lambda w: w.rlike(f"^[{text.CJK}]+$"))
    return _gold(spark).select(F.col("line_no").alias("line"), F.array_join(text.bies_tags(words), "").alias("tags"))


_CHARS = f"{_HAN_WORDS}, t AS (SELECT line, unnest(string_split(array_to_string(words, ''), '')) AS char, unnest({_TAGS}) AS state, unnest(range(length(array_to_string(words, '')))) AS pos FROM w)"


@query("hmm_emissions", f"WITH {_CHARS} SELECT state, char, count(*) AS n FROM t GROUP BY ALL")
def hmm_emissions(spark, sf_dir) -> DataFrame:
    return G.tag_counts(_gold(spark))[2]


@query("hmm_transitions", f'WITH {_CHARS} SELECT p AS state, state AS "next", count(*) AS n FROM (SELECT *, lag(state) OVER (PARTITION BY line ORDER BY pos) AS p FROM t) WHERE p IS NOT NULL GROUP BY ALL')
def hmm_transitions(spark, sf_dir) -> DataFrame:
    return G.tag_counts(_gold(spark))[1]


@query("cjk_blocks", "SELECT CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS pos, unnest(b) AS block FROM (SELECT regexp_extract_all('参与Python开发 3年经验', '[一-龥]+|[^一-龥]+') AS b)")
def cjk_blocks(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([("参与Python开发 3年经验",)], "s string").select(F.posexplode(text.blocks(F.col("s"))).alias("pos", "block"))


@query("raw_from_segmented", f"WITH {_GOLD_SQL} SELECT line_no, replace(gold, '/', '') AS raw FROM gold")
def raw_from_segmented(spark, sf_dir) -> DataFrame:
    return _gold(spark).select("line_no", text.restore_raw(F.col("gold")).alias("raw"))


_ENDS = "list_transform(range(1, len({0}) + 1), lambda i: list_sum(list_transform({0}[1:i], lambda x: length(x))))"
_TAGGED = "list_reduce(list_transform({0}, lambda x: CASE WHEN length(x) = 1 THEN ['S'] ELSE list_concat(['B'], list_concat(list_transform(range(length(x) - 2), lambda i: 'I'), ['E'])) END), lambda a, b: list_concat(a, b))"
_EVALUATED = f"""{_SPLIT},
lined AS (SELECT s.method, g.gold AS g, s.words AS t, list_transform(list_zip(g.gold, {_ENDS.format('g.gold')}), lambda x: (x[2] - length(x[1]), x[2])) AS gi, list_transform(list_zip(s.words, {_ENDS.format('s.words')}), lambda x: (x[2] - length(x[1]), x[2])) AS ti, {_TAGGED.format('g.gold')} AS gt, {_TAGGED.format('s.words')} AS tt FROM split s JOIN made g USING (k)),
scored AS (SELECT *, len(list_intersect(gi, ti)) / len(ti) AS p, len(list_intersect(gi, ti)) / len(gi) AS r, len(list_filter(list_zip(gt, tt), lambda x: x[1] = x[2])) AS same FROM lined),
ev AS (SELECT method, avg(p) AS p, avg(r) AS r, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f, avg(CASE WHEN gt = tt THEN 1.0 ELSE 0.0 END) AS exact, sum(same) / sum(len(gt)) AS tags FROM scored GROUP BY method),
result AS (SELECT method, true AS aligned, round(round(100 * p, 8), 2) AS p_macro, round(round(100 * r, 8), 2) AS r_macro, round(round(100 * f, 8), 2) AS f1_macro, round(round(100 * 2 * p * r / (p + r), 8), 2) AS f1_classic, round(round(100 * exact, 8), 2) AS exact_lines, round(round(100 * tags, 8), 2) AS tag_accuracy FROM ev)"""


@query("seg_eval", f"WITH RECURSIVE {_EVALUATED} SELECT * FROM result")
def seg_eval(spark, sf_dir) -> DataFrame:
    return G.evaluate(splits(spark, sf_dir))


@query("best_segmenter", f"WITH RECURSIVE {_EVALUATED} SELECT method, f1_classic FROM result ORDER BY f1_classic DESC, method LIMIT 1")
def best_segmenter(spark, sf_dir) -> DataFrame:
    return G.best(G.evaluate(splits(spark, sf_dir)))


_VOCABULARY = Q.Vocabulary(["北京", "上海", "深圳", "杭州", "广州", "全国"], Q.industry_terms(["互联网/电子商务", "金融业", "制造业", "建筑业"]))
_PARSED = [
    ("北京 数据分析 15k-30k 硕士", "北京", 15000, 30000, "硕士", None, None, None, "城市→北京 | 月薪→15k-30k | 学历→硕士"),
    ("shanghai python 20k+", "上海", 20000, None, None, None, None, None, "城市→上海 | 月薪→≥20k"),
    ("深圳 两万以上", "深圳", 20000, None, None, None, None, None, "城市→深圳 | 月薪→≥20k"),
    ("杭州 一万五到两万", "杭州", 15000, 20000, None, None, None, None, "城市→杭州 | 月薪→15k-20k"),
    ("广州 数据分析 硕士 3-5年经验 15k-25k", "广州", 15000, 25000, "硕士", "3-5年", None, None, "城市→广州 | 月薪→15k-25k | 学历→硕士 | 经验→3-5年"),
    ("深圳 Python 非销售岗位", "深圳", None, None, None, None, None, "销售", "城市→深圳 | 排除→销售"),
    ("应届生 本科", None, None, None, "本科", "应届生", None, None, "学历→本科 | 经验→应届生"),
    ("互联网行业 约三年 工资：8000", None, 8000, None, None, "3年及以上", "互联网/电子商务", None, "月薪→≥8k | 经验→3年及以上 | 行业→互联网/电子商务"),
    ("制造业 博士研究生 1-3年 不要出差的", None, None, None, "博士", "3年及以上", "制造业", "出差", "学历→博士 | 经验→3年及以上 | 行业→制造业 | 排除→出差"),
]
_LITERAL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _PARSED)


@query("parsed_queries", f"SELECT text, city, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high, education, experience, industry, exclude, hints FROM (VALUES {_LITERAL}) AS t(text, city, low, high, education, experience, industry, exclude, hints)")
def parsed_queries(spark, sf_dir) -> DataFrame:
    rows = []
    for r in _PARSED:
        found = Q.parse(r[0], _VOCABULARY)
        p = found.parsed
        rows.append((r[0], p["city"], p["salary_min"], p["salary_max"], p["education"], p["experience"], p["industry"], p["exclude"], " | ".join(found.hints)))
    return spark.createDataFrame(rows, "text string, city string, low int, high int, education string, experience string, industry string, exclude string, hints string")


_NUMBERS = [("两万以上", "20000以上"), ("一万五", "15000"), ("三到五年", "3-5年"), ("约三年", "约3年"), ("大概五年", "大概5年"), ("三年左右", "3年左右")]


@query("chinese_numbers", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NUMBERS) + ") AS t(text, digits)")
def chinese_numbers(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(a, with_digits(a)) for a, _ in _NUMBERS], "text string, digits string")


@query("query_terms", "SELECT * FROM (VALUES ('北京 Python3 数据分析 C++', 'python3/数据分析/c++'), ('上海 java 产品 für Straße', 'java/产品/für/straße')) AS t(text, terms)")
def query_terms(spark, sf_dir) -> DataFrame:
    words = {*_WORDS, "北京", "上海"}
    rows = [(t, "/".join(Q.query_terms(t, {"city": c}, words))) for t, c in (("北京 Python3 数据分析 C++", "北京"), ("上海 java 产品 für Straße", "上海"))]
    return spark.createDataFrame(rows, "text string, terms string")


def chinese_records(spark, sf_dir) -> DataFrame:
    """The lines as records of an index: body from the line, title from the first word."""
    none = F.lit(None).cast("string")
    made = lines(spark, sf_dir)
    return made.select(F.col("k").alias("doc_id"), F.split("gold", "/")[0].alias("title"), F.col("line").alias("body"), none.alias("company"), none.alias("industry"), none.alias("city"), F.lit(0.0).alias("salary_min"), F.lit(0.0).alias("salary_max"), none.alias("education"), none.alias("experience"), F.lit(None).cast("date").alias("pub_date"))


def chinese_index(spark, sf_dir) -> S.Index:
    docs = chinese_records(spark, sf_dir)
    words = set(_WORDS)
    return S.build(docs, docs.select("doc_id", TK.tokens(F.col("title"), words).alias("title_tokens"), TK.tokens(F.col("body"), words).alias("body_tokens")))


_ASKED = "Python3 产品 工程师"
_LONG = "list_filter(list_transform({0}, lambda x: lower(x)), lambda x: length(x) >= 2)"
_CHINESE = f"""{_SPLIT},
rec AS (SELECT k AS doc_id, gold[1] AS title, NULL AS company FROM made),
tok AS (SELECT k AS doc_id, {_LONG.format("[gold[1]]")} AS title_tokens, {_LONG.format('words')} AS body_tokens FROM made JOIN split USING (k) WHERE method = 'fewest')"""


@query("segmented_search", "WITH RECURSIVE " + V.score_sql(["python3", "产品", "工程师"]).replace(V.TOK, _CHINESE).replace("FROM documents", "FROM part") + " SELECT doc_id, score FROM hits")
def segmented_search(spark, sf_dir) -> DataFrame:
    """Search over Han text: index and query are cut by the same tokeniser and dictionary."""
    terms = Q.query_terms(_ASKED, {}, set(_WORDS))
    return S.scored(chinese_index(spark, sf_dir), S.Request(terms)).select("doc_id", "score")


_PAIRS = "list_reduce(list_transform(regexp_extract_all(lower(line || rest_), '[一-鿿]+|[a-z0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[一-鿿]') THEN list_transform(range(1, greatest(length(x), 2)), lambda i: substring(x, i, 2)) ELSE [x] END), lambda a, b: list_concat(a, b))"


@query("token_pairs", f"WITH {_MADE} SELECT k, array_to_string({_PAIRS}, '/') AS tokens FROM (SELECT *, array_to_string(rest, '') AS rest_ FROM han)")
def token_pairs(spark, sf_dir) -> DataFrame:
    """Tokens without a dictionary: Han runs as overlapping pairs."""
    return lines(spark, sf_dir).select("k", text.encode_tokens(TK.tokens(F.col("line"))).alias("tokens"))

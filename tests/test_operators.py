"""Operators against plain models and values worked by hand."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import chinese, dates, present, text
from tessera.operators import classify as C
from tessera.operators import cluster as CL
from tessera.operators import evaluate as E
from tessera.operators import filters as FL
from tessera.operators import index as IX
from tessera.operators import keywords as K
from tessera.operators import profile as P
from tessera.operators import sampling as SA
from tessera.operators import search as S
from tessera.operators import segment as G
from tessera.operators import tokenise as TK
from tessera.plans import corpus_build as CB
from tessera.plans import query_parser as Q
from tessera.plans.service import Service
from tessera.sources import readers, writers

WORDS = {"研究", "研究生", "生命", "命", "起源"}
HAN = st.text("研究生命起源的", max_size=14)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


# Segmentation


@given(HAN)
def test_segmenters_keep_the_text(s):
    for method in (G.forward, G.backward, G.bidirectional, G.fewest):
        assert "".join(method(s, WORDS, 3)) == s


@given(HAN)
def test_both_ways_has_no_more_words_than_either(s):
    both = len(G.bidirectional(s, WORDS, 3))
    assert both <= min(len(G.forward(s, WORDS, 3)), len(G.backward(s, WORDS, 3)))
    assert len(G.fewest(s, WORDS, 3)) <= both


def test_models_learn_their_gold_lines(spark):
    gold = spark.createDataFrame([(1, "研究/生命/的/起源/"), (2, "生命/起源/")], "line_no int, gold string")
    lines = [["研究", "生命", "的", "起源"], ["生命", "起源"]]
    for model in (G.Hmm(*G.tag_counts(gold)), G.Bigram(G.gold_words(gold)), G.Chain(lines)):
        assert model("研究生命的起源") == lines[0]
        assert model("") == []
        assert "".join(model("未知命起")) == "未知命起"


def test_only_han_blocks_are_cut():
    cut = G.segment_line("参与Python研究生命 3年", G.by_dictionary(G.fewest, WORDS))
    assert cut == ["参", "与", "Python", "研究", "生命", " 3", "年"]


# Query understanding


@pytest.mark.parametrize(("query", "salary"), [("15k-30k", (15000, 30000)), ("20k+", (20000, None)), ("两万以上", (20000, None)), ("一万五到两万", (15000, 20000)), ("3-5年经验 15k-25k", (15000, 25000)), ("月薪8000", (8000, None)), ("不低于1.5万", (15000, None)), ("", (None, None))])
def test_salary(query, salary):
    assert Q.salary(query) == salary


@pytest.mark.parametrize(("query", "years"), [("应届生", "应届生"), ("3年以上", "3年及以上"), ("3-5年", "3-5年"), ("1-3年", "3年及以上"), ("约三年", "3年及以上"), ("五年经验", None), ("5年经验", "5年及以上"), ("x", None)])
def test_experience(query, years):
    assert Q.experience(query) == years


def test_parse_gives_hints_and_filters():
    v = Q.Vocabulary(["北京", "上海"], Q.industry_terms(["互联网/电子商务"]))
    p = Q.parse("北京 互联网行业 本科 20k+ 不要外包", v)
    assert p.parsed == {"city": "北京", "education": "本科", "industry": "互联网/电子商务", "experience": None, "salary_min": 20000, "salary_max": None, "exclude": "外包"}
    assert len(p.hints) == 5
    assert Q.experience_filter("3-5年") == "5年及以上"
    assert Q.experience_filter("应届生") == "经验不限"


@pytest.mark.parametrize(("numeral", "value"), [("三", 3), ("十五", 15), ("两万", 20000), ("一千二百", 1200), ("12", 12), ("x", None)])
def test_chinese_numerals(numeral, value):
    assert chinese.to_int(numeral) == value


# Text


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab <>&\"'那", max_size=20))
def test_marks_strip_back_to_the_escaped_text(spark, s):
    marked = one(spark, s, lambda c: present.highlight(c, ["a", "ab"]))
    assert marked.replace(present.MARK[0], "").replace(present.MARK[1], "") == one(spark, s, present.escape_html)


def test_highlight_takes_the_case_of_the_query(spark):
    assert one(spark, "Python & Java", lambda c: present.highlight(c, ["python"])) == '<mark class="highlight">python</mark> &amp; Java'
    assert one(spark, None, lambda c: present.highlight(c, ["python"])) == ""
    assert one(spark, "mark it", lambda c: present.highlight(c, ["mark", "it"])) == '<mark class="highlight">mark</mark> <mark class="highlight">it</mark>'


def test_snippet_is_cut_around_the_first_term(spark):
    got = one(spark, "x" * 200 + " hit " + "y" * 200, lambda c: present.snippet(c, ["none", "HIT"], 20, mark=False))
    assert got == "..." + "x" * 9 + " hit " + "y" * 6 + "..."


@pytest.mark.parametrize(("raw", "date"), [("2026/1/5", "2026-01-05"), ("2026.01.05", "2026-01-05"), ("01/05/2026", "2026-01-05"), ("25/12/2025", "2025-12-25"), ("2026-01-05 10:00:00", "2026-01-05"), ("bad", None), (None, None)])
def test_dates(spark, raw, date):
    assert one(spark, raw, lambda c: dates.iso(dates.parse_date(c))) == date


@pytest.mark.parametrize(("f", "raw", "value"), [
    (text.normalize_education, "本科及以上", "本科"), (text.normalize_education, "中专", "中技/中专"), (text.normalize_education, "MBA", "学历不限"), (text.normalize_education, None, "学历不限"),
    (text.normalize_experience, "1-3年", "3年及以上"), (text.normalize_experience, "5-10年", "8年及以上"), (text.normalize_experience, "7年", "8年及以上"), (text.normalize_experience, "15年", "5年及以上"), (text.normalize_experience, "无经验", "经验不限"),
    (text.normalize_city, "上海市", "上海"), (text.normalize_city, "广东省", "广东"), (text.normalize_city, "恩施自治州", "恩施"), (text.normalize_city, "其他", "全国"), (text.normalize_city, None, "全国"),
])
def test_normalisers(spark, f, raw, value):
    assert one(spark, raw, f) == value
    assert one(spark, value, f) == value or f is text.normalize_experience


def test_cleaning(spark):
    assert one(spark, "a\xa0b　c\r\nd\t\te\n\n\n\nf", lambda c: text.clean_text(c, ("某站",))) == "a b c\nd e\n\nf"
    assert one(spark, "见 https://a.cn/x?y=1 。", lambda c: text.clean_text(c, ("某站",))) == "见 。"
    assert one(spark, None, lambda c: text.clean_text(c, ("某站",))) == ""


# Index and search


@pytest.fixture(scope="module")
def little(spark):
    docs = [(0, "aa bb", "aa cc aa", "co", 1.0), (1, "dd", "bb", "other", 2.0), (2, "zz", "bb aa", None, None)]
    df = spark.createDataFrame([(i, t, b, c, "it", "X", s, s) for i, t, b, c, s in docs], "doc_id long, title string, body string, company string, industry string, city string, salary_min double, salary_max double")
    df = df.selectExpr("*", "cast(null as string) education", "cast(null as string) experience", "cast(null as string) category", "cast(null as date) pub_date", "cast(null as date) end_date")
    return df, df.select("doc_id", text.tokens(F.col("title")).alias("title_tokens"), text.tokens(F.col("body")).alias("body_tokens"))


def test_positions_count_filtered_tokens(spark):
    t = spark.createDataFrame([(0, ["aa", "of", "aa"], ["bb"])], "doc_id long, body array<string>, title array<string>")
    got = {r.term: (r.tf, r.positions) for r in IX.postings(t, ["body", "title"], ["of"]).collect()}
    assert got == {"aa": (2, [0, 2]), "bb": (1, [3])}


def test_ltc_weights_by_hand(spark):
    t = spark.createDataFrame([(1, ["aa", "aa", "bb"]), (2, ["bb"])], "doc_id long, body array<string>")
    got = {(r.doc_id, r.term): r.w for r in IX.weights(IX.postings(t, ["body"]), 2).collect()}
    assert got == {(1, "aa"): 1.0, (1, "bb"): 0.0, (2, "bb"): 0.0}


def test_index_agrees_with_the_scan_on_all_terms(little):
    _, tokens = little
    post = IX.postings(tokens, ["title_tokens", "body_tokens"])
    assert IX.verify(post, tokens, ["title_tokens", "body_tokens"]).count() == 0
    assert {r.doc_id for r in IX.boolean_and(post, ["aa", "bb"]).collect()} == {0, 2}
    assert IX.boolean_and(post, []).count() == IX.boolean_and(post, ["aa", "nowhere"]).count() == 0


def test_score_by_hand():
    assert round((0.3 * 2**2 + 0.1) * 50, 2) == 65.0


def test_final_score(spark):
    row = spark.range(1).select((S.final_score(F.lit(0.3), F.lit(2), F.lit(0.1)) * 50).alias("x")).first()
    assert round(row.x, 2) == 65.0


def test_bonus_lifts_documents_without_terms(little):
    ix = S.build(*little)
    got = {r.doc_id: r.score for r in S.scored(ix, S.Request(["cc"], "other jobs")).collect()}
    assert got[1] == 5.0
    assert got[0] > 0
    assert 2 not in got


def test_null_salary_passes(little):
    df, _ = little
    assert {r.doc_id for r in FL.apply(df, FL.Filters(salary_min=2)).collect()} == {1, 2}
    assert FL.apply(df, FL.Filters()).count() == 3


def test_no_terms_give_the_constant_score(little):
    rows = S.search(S.build(*little), S.Request([], page_size=2, page=2)).collect()
    assert [(r.doc_id, r.score, r["rank"]) for r in rows] == [(2, 50.0, 3)]
    assert S.page_count(45) == 3
    assert S.page_count(0) == 0
    assert S.page_window(1, 9) == [1, 2, 3]


def test_blocked_neighbours_are_those_of_the_join(spark, sf_dir):
    from tessera.queries import views as V

    ix = V.index(spark, sf_dir)
    a = S.top_similar(S.similar_pairs(ix.matrix, ix.norms))
    b = S.similar_blocked(ix.matrix, ix.norms, block=40)
    assert a.exceptAll(b.select(a.columns)).count() == 0
    assert a.count() == b.count()


def test_service_answers(little):
    service = Service(S.build(*little), Q.Vocabulary(["X"]))
    result = service.search("cc")
    assert [(r.doc_id, r.company) for r in result.rows.collect()] == [(0, "co")]
    assert (result.total, result.total_pages, result.terms) == (1, 1, ["cc"])
    assert service.record(99) is None
    assert service.record(0)["record"].first().title == "aa bb"
    assert {"industries", "latest", "cities"} == set(service.home())
    assert service.facets().count() > 0
    assert service.industries().first().n == 3


# Keywords and clusters


def test_pagerank_spreads_what_loose_nodes_hold():
    x = K._rank(["a", "b", "c"], [{"src": "a", "dst": "b", "weight": 2}], 0.85, 100)
    assert math.isclose(x.sum(), 1)
    assert math.isclose(x[0], x[1])
    assert x[0] > x[2]


def test_textrank_against_a_plain_model(spark):
    words = "aa bb cc aa bb dd aa ee".split()
    t = spark.createDataFrame([(7, [], words)], "doc_id long, title_tokens array<string>, body_tokens array<string>")
    candidates = spark.createDataFrame([(7, w) for w in sorted(set(words))], "doc_id long, term string")
    edges = {}
    for i, a in enumerate(words):
        for b in words[i + 1 : i + 5]:
            if a != b:
                key = tuple(sorted((a, b)))
                edges[key] = edges.get(key, 0) + 1
    got = K.cooccurrence(t, candidates)
    assert {(r.src, r.dst): r.weight for r in got.collect()} == edges
    names = sorted(set(words))
    m = np.zeros((5, 5))
    for (a, b), w in edges.items():
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = w
    x = np.full(5, 0.2)
    for _ in range(50):
        x = 0.15 / 5 + 0.85 * (m / m.sum(0)) @ x
    ranked = {r.term: r.score for r in K.textrank(candidates, got).collect()}
    assert all(math.isclose(ranked[n], v, abs_tol=1e-9) for n, v in zip(names, x, strict=True))


@pytest.mark.parametrize("method", ["ward", "single", "complete"])
def test_linkage_finds_what_is_apart(method):
    x = np.array([[0, 0], [0, 1], [10, 0], [10, 1], [50, 50]], float)
    labels = CL.linkage(x, 3, method)
    assert labels[0] == labels[1] != labels[2] == labels[3] != labels[4]


def test_cluster_quality_against_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, d, float(x[i, d])) for i in range(12) for d in range(4)], "item int, dim int, w double")
    per, _ = CL.quality(vectors, spark.createDataFrame([(i, i % 3) for i in range(12)], "item int, cluster int"))
    for r in per.collect():
        own = x[[i for i in range(12) if i % 3 == r.cluster]]
        sims = own @ own.T
        assert math.isclose(r.intra, sims[np.triu_indices(4, 1)].mean(), abs_tol=1e-6)


# Classification, sampling, metrics


def test_unknown_text_has_no_label(spark):
    assert C.predict_text(spark, "  ", [], None, 1, None, None, {})["label_id"] == -1


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.integers(1, 60), min_size=1, max_size=8), st.integers(8, 150))
def test_quotas_meet_the_total(sizes, total):
    out = SA.quotas(sizes, total)
    assert sum(out.values()) == min(total, sum(sizes.values()))
    assert all(1 <= out[k] <= sizes[k] for k in sizes)


def test_retrieval_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, i + 1, r) for i, r in enumerate([1, 0, 1, 0, 0])] + [(2, 1, 0), (3, 1, None)], "query_id int, rank int, rel int")
    m = E.per_query(E.judged(rows), (5,), 5).collect()
    assert len(m) == 1
    assert (m[0].p_at_5, m[0].ap, m[0].r_precision, m[0].ndcg) == (0.4, 0.833333, 0.5, 0.919721)
    assert E.averages(E.per_query(E.judged(rows, False), (5,), 5)).first()["map"] == pytest.approx(0.4166665, abs=1e-6)


# Profiles, sources and sinks, corpus build


def test_profiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert {r.column: r.n_present for r in P.missing(empty).collect()} == {"a": 0, "b": 0}
    assert P.numeric_stats(empty, ["b"]).first()["mean"] is None
    assert P.value_counts(empty, "a").count() == 0


def test_csv_round_trip_with_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nline', ["x", "y"]), (2, None, [])], "k int, body string, words array<string>")
    writers.write_csv(df.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    back = {r.k: r for r in readers.read_csv(spark, str(part)).collect()}
    assert back["1"].body == 'a "q"\nline'
    assert back["1"].words == "x/y"


@pytest.mark.parametrize("encoding", ["gbk", "utf-8", "utf-16"])
def test_encodings_are_told_apart(encoding):
    raw = "招聘岗位,职位描述\n".encode(encoding)
    assert raw.decode(readers.detect_encoding(raw if encoding == "gbk" else raw)) is not None
    assert readers.detect_encoding("岗位".encode("gbk")[:3]) == "gbk"
    assert readers.detect_encoding(b"\xef\xbb\xbfabc") == "utf-8"


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    assert readers.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert readers.read_table(spark, str(tmp_path / "none"), "a int").count() == 0


def test_annotations_do_not_leak_into_other_blocks(spark):
    body = "### 样本 1\n文本\n### 样本 2\n文本\n【标注】: 4\n"
    df = spark.createDataFrame([(body,)], "value string")
    assert [(r.sample_no, r.label) for r in readers.parse_labels(df).collect()] == [(2, 4)]
    gold = spark.createDataFrame([("### 文档 1 (原始ID: 9)\n正文\n金标准关键词: 甲, 乙\n",)], "value string")
    assert [(r.doc_id, r.gold) for r in readers.parse_gold(gold).collect()] == [(9, ["甲", "乙"])]


def test_lines_skip_comments(spark):
    df = spark.createDataFrame([("# head",), (" the ",), ("",), ("of",)], "value string")
    assert [r.line for r in readers.lines(df).collect()] == ["the", "of"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1)], "name string, n int")
    assert json.loads(writers.json_report({"rows": df, "k": 1})) == {"rows": [{"name": "a<b", "n": 1}], "k": 1}
    assert "a&lt;b" in writers.html_report(df, {"nulls": (True, "none")})
    assert writers.text_table(df, "T").startswith("T\n=")
    assert writers.archive({"a": {"x": 1}, "b": None}) == {"a": {"x": 1}}
    writers.write_index(df.withColumnRenamed("name", "term"), str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix")).count() == 1


def test_corpus_build(spark):
    raw = spark.createDataFrame([("1", "公司", "业", "t", "上海市", "20000", "10000", "b 由 x", "本科", "7年", "2026/1/5"), ("2", None, "业", "t", "", "x", "", "b", "", "", "bad")], "`编号` string, `企业名称` string, `行业` string, title string, city string, lo string, hi string, body string, edu string, exp string, pub string")
    aliases = {"ext_id": ["编号"], "company": ["公司名称", "企业名称"], "industry": ["行业"], "title": ["title"], "city": ["city"], "salary_min": ["lo"], "salary_max": ["hi"], "body": ["body"], "education": ["edu"], "experience": ["exp"], "pub_date": ["pub"], "stock": ["none"]}
    df, missing = CB.preprocess(raw, aliases)
    assert missing == ["stock"]
    rows = CB.clean(df, ("某站",)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.salary_min, r.salary_max, r.city, r.education, r.experience) == (10000.0, 20000.0, "上海", "本科", "8年及以上")
    assert (str(r.pub_date), str(r.end_date)) == ("2026-01-05", "2026-03-06")
    report = CB.quality_report(df, CB.clean(df, ("某站",)), {"links": "http"})
    assert report["comparison"].count() == len(df.columns)


def test_features_have_the_inner_products_of_all_documents(spark):
    r = np.random.default_rng(3)
    x = r.random((40, 900)) * (r.random((40, 900)) < 0.2)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    rows = [(f"t{i:02d}", int(d), float(x[i, d])) for i in range(40) for d in np.flatnonzero(x[i])]
    words = CL.Words.of(spark.createDataFrame(rows, "term string, doc_id long, w double"))
    assert words.terms == [f"t{i:02d}" for i in range(40)]
    assert np.abs(words.x @ words.x.T - x @ x.T).max() < 1e-9
    none = CL.Words.of(spark.createDataFrame([], "term string, doc_id long, w double"))
    assert none.terms == [] and len(CL.kmeans(none)[0]) == 0 and none.labelled(CL.hierarchical(none, 3)).count() == 0


def test_kmeans_and_silhouette():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.3, (20, 4)) for c in (0, 4, 9)])
    labels = CL.kmeans_labels(x, 3)
    assert all(len(set(labels[k : k + 20])) == 1 for k in (0, 20, 40)) and len(set(labels)) == 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(60):
        own = [d[i, j] for j in range(60) if labels[j] == labels[i] and j != i]
        other = min(np.mean([d[i, j] for j in range(60) if labels[j] == c]) for c in set(labels) - {labels[i]})
        want.append((other - np.mean(own)) / max(other, np.mean(own)))
    assert math.isclose(CL.silhouette(x, labels), np.mean(want), rel_tol=1e-9)
    assert CL.silhouette(x, np.zeros(60, int)) == -1.0
    assert len(set(CL.kmeans_labels(np.ones((5, 2)), 3))) >= 1


def test_principal_components():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (50, 5)) * [5, 3, 1, 0.5, 0.1]
    xy, shares = CL.pca(CL.Words(None, [str(i) for i in range(50)], x))
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(xy.var(0, ddof=1), values[:2]) and np.allclose(shares, values[:2] / values.sum())
    assert abs(xy[:, 0] @ xy[:, 1]) < 1e-8 and (xy[np.abs(xy).argmax(0), [0, 1]] > 0).all()


def test_overlap_of_clusterings(spark):
    rows = [(i, m, c) for m, own in (("x", [0, 0, 0, 1, 1, 1]), ("y", [5, 5, 6, 6, 6, 6])) for i, c in enumerate(own)]
    assert [tuple(r) for r in CL.overlap(spark.createDataFrame(rows, "item int, method string, cluster int")).collect()] == [("x", "y", round(5 / 6, 6))]


# One tokeniser, stored indexes and models

TEXTS = ["für Straße k8s C++ 北京 数据分析 Python3", "naïve café_au", "", None, "单", "a b2 C#", "数据 x 分析师。产品"]


def test_documents_and_queries_have_the_same_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    for words in (set(), {"数据", "分析", "分析师", "北京", "产品"}):
        got = [r[0] for r in df.select(TK.tokens(F.col("s"), words)).collect()]
        assert got == [[w for w in TK.words_of(t, words) if len(w) >= 2] for t in TEXTS]
    assert TK.words_of(TEXTS[0], {"北京", "数据", "分析"}) == ["für", "straße", "k8s", "c++", "北京", "数据", "分析", "python3"]
    assert TK.words_of("数据，x!", {"数据"}, punctuation=True) == ["数据", "，", "x", "!"]
    assert Q.tokenize("Python3 数据分析 für") == ["python3", "数据", "据分", "分析", "für"]


def test_products_of_two_sides(spark):
    r = np.random.default_rng(4)
    x = r.random((60, 30)) * (r.random((60, 30)) < 0.4)
    rows = [(int(d), f"t{t}", float(x[d, t]), int(d >= 20)) for d in range(60) for t in np.flatnonzero(x[d])]
    df = spark.createDataFrame(rows, "doc_id long, term string, u double, side int")
    got = {(p.i, p.j): p.score for p in S.best_products(df, 3, block=7).collect()}
    for i in range(20):
        best = sorted(range(20, 60), key=lambda j: -(x[i] @ x[j]))[:3]
        assert all(math.isclose(got[i, j], x[i] @ x[j], abs_tol=1e-9) for j in best if x[i] @ x[j] > 0)
    assert all(i < 20 <= j for i, j in got)


def test_stored_model_predicts_as_before(spark, tmp_path):
    rows = [(i, ["good", "fine", f"w{i}"] if i % 2 else ["bad", "poor", f"w{i}"]) for i in range(20)]
    tokens = spark.createDataFrame([*rows, (98, ["good", "unknown"]), (99, [])], "doc_id long, tokens array<string>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(98, None)], "doc_id long, label int")
    model = C.NbModel.fit(tokens, labels)
    own = sorted(map(tuple, model.predict(tokens).collect()))
    model.save(f"file://{tmp_path}/m")
    assert sorted(map(tuple, C.NbModel.load(spark, f"file://{tmp_path}/m").predict(tokens).collect())) == own
    assert {d: label for d, _, label, _ in own} == {i: i % 2 for i in range(20)} | {98: 1}


def test_stored_index_answers_as_before(little, tmp_path):
    docs, tokens = little
    ix = S.build(docs, tokens)
    before = S.scored(ix, S.Request(["cc"])).select("doc_id", "score").collect()
    ix.written(f"file://{tmp_path}/ix")
    again = S.Index.read(docs, f"file://{tmp_path}/ix")
    assert S.scored(again, S.Request(["cc"])).select("doc_id", "score").collect() == before and len(before) == 1


# Command line and sources


def test_build_search_and_evaluate(spark, tmp_path, capsys):
    from tessera import __main__ as CLI

    head = "编号,企业,行业,岗位,城市,最低,最高,描述,学历,经验,发布"
    rows = [f"{k},公司{k},软件,{'数据分析师' if k % 2 else '产品经理'},{'北京市' if k < 6 else '上海市'},{8000 + k},{12000 + k},负责Python3开发 word{k} 该数据由某站整理。,本科及以上,1-3年,2026/1/{k + 1}" for k in range(12)]
    (tmp_path / "raw.csv").write_text("\n".join([head, *rows]), encoding="utf-8")
    names = dict(ext_id="编号", company="企业", industry="行业", title="岗位", city="城市", salary_min="最低", salary_max="最高", body="描述", education="学历", experience="经验", pub_date="发布")
    (tmp_path / "aliases.json").write_text(json.dumps({k: [v] for k, v in names.items()}))
    (tmp_path / "words.txt").write_text("数据\n分析师\n产品\n经理\n开发\n负责", encoding="utf-8")
    out = f"file://{tmp_path}/out"
    words = ["--dictionary", f"file://{tmp_path}/words.txt"]
    CLI.main(["build", f"file://{tmp_path}/raw.csv", out, "--aliases", str(tmp_path / "aliases.json"), "--brand", "某站", *words], spark)
    assert "missing" in capsys.readouterr().out
    assert {r.city for r in spark.read.parquet(f"{out}/cleaned").collect()} == {"北京", "上海"}
    CLI.main(["search", out, "分析师 北京", *words], spark)
    shown = capsys.readouterr().out
    assert shown.startswith("3 hits, page 1 of 1; 城市→北京") and "数据分析师".replace("分析师", "") in shown
    (tmp_path / "specs.json").write_text(json.dumps([{"query_id": 1, "q": "word3"}, {"query_id": 2, "q": "产品"}]))
    CLI.main(["template", out, str(tmp_path / "specs.json"), f"file://{tmp_path}/t.json", *words], spark)
    template = json.loads((tmp_path / "t.json").read_text())
    assert [len(q["results"]) for q in template] == [1, 6] and template[0]["results"][0]["relevant"] is None
    for q in template:
        for r in q["results"]:
            r["relevant"] = int(r["rank"] <= 2)
    (tmp_path / "judged.json").write_text(json.dumps(template))
    capsys.readouterr()
    CLI.main(["evaluate", f"file://{tmp_path}/judged.json", "--archive", f"file://{tmp_path}/a.json"], spark)
    assert "Retrieval" in capsys.readouterr().out
    means = json.loads((tmp_path / "a.json").read_text())["means"][0]
    assert means["n_queries"] == 2 and means["map"] == 1.0


def test_segmented_files_and_categories(spark, tmp_path):
    (tmp_path / "s.csv").write_text("k,最低,描述_分词,岗位_分词\n1,面议,a/b/ /c,x\n2,900,,y/z\n", encoding="utf-8")
    got = {r.k: (r.body_tokens, r.title_tokens) for r in readers.read_segmented(spark, f"file://{tmp_path}/s.csv").collect()}
    assert got == {"1": (["a", "b", "c"], ["x"]), "2": ([], ["y", "z"])}
    named = readers.read_segmented(spark, f"file://{tmp_path}/s.csv", {"岗位_分词": "t"})
    assert named.columns == ["k", "最低", "描述_分词", "t"]
    raw = readers.read_raw(spark, f"file://{tmp_path}/s.csv", numbers=("最低",))
    assert [r["最低"] for r in raw.orderBy("k").collect()] == [None, 900.0]
    (tmp_path / "c.json").write_text(json.dumps([{"name": "n", "definition": "d", "merged_from": "m", "keywords": ["a", "b"]}, {"name": "o"}]))
    assert [(r.label, r.name, r["keywords"]) for r in readers.read_categories(spark, f"file://{tmp_path}/c.json").collect()] == [(0, "n", ["a", "b"]), (1, "o", None)]


# Work that grows with the input and no faster


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_not_shuffled_and_copies_give_few_candidates(spark):
    df = spark.createDataFrame([(d, t, 0.5) for d in range(60) for t in "abcd"], "doc_id long, term string, u double")
    near = S.best_products(df, 3, block=7)
    assert not any(f"Exchange {kind}partitioning" in plan_of(near) for kind in ("hash", "range"))
    rows = near.collect()
    # A row stands in at most four tasks as the left one and in four as the right one.
    assert len(rows) <= 60 * 3 * 2 * spark.sparkContext.defaultParallelism
    best = {}
    for r in S.top_similar(spark.createDataFrame(rows), 3).collect():
        best.setdefault(r.i, {})[r["rank"]] = (r.j, r.score)
    assert best == {i: {k: (j, 1.0) for k, j in enumerate([j for j in range(5) if j != i][:3], 1)} for i in range(60)}


def test_products_are_rounded_as_spark_rounds(spark):
    x = [0.1234565, 0.1234575, 0.12345649999999999, 1.0000005, 2.5e-7, 5e-7, 0.3333335, 0.0000015]
    want = [r.v for r in spark.createDataFrame(list(enumerate(x)), "i int, v double").orderBy("i").select(F.round("v", 6).alias("v")).collect()]
    assert [v / 1e6 for v in S._rounded(np.array(x), 6)] == want


def test_terms_are_counted_in_slices(spark, monkeypatch):
    rows = [(d, [f"w{k % (d + 1)}" for k in range(3 * d)], ["ab", f"w{d}"] if d % 2 else None) for d in range(12)]
    tokens = spark.createDataFrame(rows, "doc_id long, body array<string>, title array<string>").coalesce(1)
    whole = {n: sorted(map(tuple, f().collect())) for n, f in (("post", lambda: IX.postings(tokens, ["body", "title"])), ("tf", lambda: IX.term_counts(tokens, {"body": 1.0, "title": 2.0})))}
    batch = tokens.toArrow().to_batches()[0]
    parts = list(IX._slices(batch, ["body", "title"], 10))
    sizes = [sum(len(p[f][i].as_py() or []) for f in ("body", "title") for i in range(p.num_rows)) for p in parts]
    assert sum(p.num_rows for p in parts) == 12 and all(n <= 10 or p.num_rows == 1 for n, p in zip(sizes, parts, strict=True)) and len(parts) > 5
    monkeypatch.setattr(IX, "TOKENS", 10)
    assert sorted(map(tuple, IX.postings(tokens, ["body", "title"]).collect())) == whole["post"]
    assert sorted(map(tuple, IX.term_counts(tokens, {"body": 1.0, "title": 2.0}).collect())) == whole["tf"]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_weights_count_the_terms_once(spark):
    tokens = spark.createDataFrame([(1, ["a", "b", "a"], ["c"]), (2, ["a"], None)], "doc_id long, body array<string>, title array<string>")
    matrix = IX.tfidf_matrix(tokens, ["body", "title"], 2)
    assert plan_of(matrix).count("MapInArrow") == 1
    assert {(r.doc_id, r.term): round(r.w, 9) for r in matrix.collect()} == {(1, "a"): round(2 * math.log(2 / 3), 9), (1, "b"): 0.0, (1, "c"): 0.0, (2, "a"): round(math.log(2 / 3), 9)}


def test_word_vectors_are_not_shuffled_by_word(spark):
    rows = spark.createDataFrame([(d, t, 1.0 + d) for d in range(5) for t in "ab"], "doc_id long, term string, w double")
    vectors = CL.word_vectors(rows, spark.createDataFrame([("a",)], "term string"))
    assert "SortMergeJoin" not in plan_of(vectors)
    assert {r.doc_id: round(r.w, 9) for r in vectors.collect()} == {d: round((1 + d) / math.sqrt(55), 9) for d in range(5)}


def test_scores_read_the_vectors_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "x", 1.0), (2, "x", 1.0)], "doc_id long, term string, w double").write.parquet(f"file://{tmp_path}/own_vectors")
    counts = spark.createDataFrame([(0, "a", 2), (1, "a", 1), (1, "b", 3)], "label int, term string, n long")
    totals = spark.createDataFrame([(0, 2, 2), (1, 3, 4)], "label int, docs long, total long")
    scores = C.nb_scores(spark.read.parquet(f"file://{tmp_path}/own_vectors"), counts, totals, 0.5)
    assert plan_of(scores).count("FileScan parquet") == 1
    prior, total, n = {0: math.log(2 / 5), 1: math.log(3 / 5)}, {0: 2, 1: 4}, {(0, "a"): 2, (1, "a"): 1, (1, "b"): 3}
    seen = lambda c: sum(math.log((n.get((c, t), 0) + 0.5) / (total[c] + 1.0)) for t in "ab")
    want = {(d, c): round(prior[c] + (seen(c) if d == 1 else 0) - math.log(2), 9) for d in (1, 2) for c in (0, 1)}
    assert {(r.doc_id, r.label): r.score for r in scores.collect()} == want


@pytest.mark.parametrize("bound", [3, 100_000])
def test_percentiles_meet_in_no_task(spark, bound):
    r = np.random.default_rng(7)
    x = [None if v < -2 else round(float(v), 3) for v in r.normal(0, 1, 3000)]
    y = [float(v) for v in r.integers(0, 4, 3000)]
    df = spark.createDataFrame(list(zip(x, y, [None] * 3000, strict=True)), "x double, y double, z double")
    got = P.percentiles(df, ["x", "y", "z"], (0.0, 0.25, 0.5, 0.75, 1.0), values=bound, accuracy=50)
    own = [v for v in x if v is not None]
    assert np.allclose(got["x"], np.percentile(own, [0, 25, 50, 75, 100]), atol=1e-12) and got["y"] == list(np.percentile(y, [0, 25, 50, 75, 100])) and got["z"] == [None] * 5
    assert "percentile(" not in plan_of(P.numeric_stats(df, ["x", "y", "z"]))

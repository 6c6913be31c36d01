"""Index, weights, search, facets, similar items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import present
from tessera.operators import index as IX
from tessera.operators import keywords as K
from tessera.operators import profile as P
from tessera.operators import search as S
from tessera.operators.filters import Filters
from tessera.plans import query_parser as Q
from tessera.plans import service as SV
from tessera.queries import views as V
from tessera.queries.mining import TFIDF as KEYWORDS
from tessera.registry import query
from tessera.sources import readers

_TOP = "row_number() OVER (ORDER BY score DESC, doc_id)"
_FIELDS = ["body_tokens", "title_tokens"]


def _as_text(positions) -> F.Column:
    return F.array_join(F.transform(positions, lambda p: p.cast("string")), ",")


@query("inverted_index", f"WITH {V.POST} SELECT term, doc_id, tf, positions FROM post")
def inverted_index(spark, sf_dir) -> DataFrame:
    return V.all_postings(spark, sf_dir).select("term", "doc_id", "tf", _as_text(F.col("positions")).alias("positions"))


@query("lexicon", f"WITH {V.POST} SELECT term, CAST(doc_id // {IX.SPAN} AS BIGINT) AS part, count(*) AS df, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM post GROUP BY ALL")
def lexicon(spark, sf_dir) -> DataFrame:
    line = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), " ")
    return IX.lexicon(V.stored_postings(spark, sf_dir)).select("term", "part", "df", line.alias("postings"))


@query("index_stats", f"WITH {V.POST} SELECT (SELECT count(*) FROM occ) AS raw_tokens, CAST(sum(df) AS BIGINT) AS valid_postings, count(*) AS terms, round(avg(df), 6) AS avg_df FROM df")
def index_stats(spark, sf_dir) -> DataFrame:
    return IX.index_stats(V.token_rows(spark, sf_dir), _FIELDS, V.all_postings(spark, sf_dir))


@query("doc_freq", f"WITH {V.POST} SELECT term, df FROM df")
def doc_freq(spark, sf_dir) -> DataFrame:
    return IX.document_frequency(V.stored_postings(spark, sf_dir))


@query("boolean_and", f"WITH {V.TOK} SELECT doc_id FROM tok WHERE list_has_all(list_concat(title_tokens, body_tokens), [{V.quoted(V.TERMS)}])")
def boolean_and(spark, sf_dir) -> DataFrame:
    return IX.boolean_and(V.stored_postings(spark, sf_dir), V.TERMS)


@query("boolean_or", f"WITH {V.TOK} SELECT doc_id FROM tok WHERE list_has_any(list_concat(title_tokens, body_tokens), [{V.quoted(V.TERMS)}])")
def boolean_or(spark, sf_dir) -> DataFrame:
    return IX.boolean_or(V.stored_postings(spark, sf_dir), V.TERMS)


@query("boolean_not", f"WITH {V.TOK} SELECT doc_id FROM tok WHERE NOT list_has_any(list_concat(title_tokens, body_tokens), [{V.quoted(V.TERMS)}])")
def boolean_not(spark, sf_dir) -> DataFrame:
    return IX.boolean_not(V.table(spark, sf_dir, "documents"), V.stored_postings(spark, sf_dir), V.TERMS)


@query("sequential_search", f"WITH {V.TOK} SELECT doc_id FROM tok WHERE list_has_all(list_concat(title_tokens, body_tokens), [{V.quoted(V.TERMS)}])")
def sequential_search(spark, sf_dir) -> DataFrame:
    return IX.sequential_and(V.token_rows(spark, sf_dir), _FIELDS, V.TERMS)


@query("seq_vs_inverted", f"WITH {V.POST} SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS mismatches FROM post")
def seq_vs_inverted(spark, sf_dir) -> DataFrame:
    post = V.stored_postings(spark, sf_dir)
    bad = IX.verify(post, V.token_rows(spark, sf_dir), _FIELDS).agg(F.count(F.lit(1)).alias("mismatches"))
    return post.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(bad)  # one row each


@query("search_comparison", f"WITH {V.TOK} SELECT unnest(['scan', 'index']) AS method, count(*) AS hits FROM tok WHERE list_has_all(list_concat(title_tokens, body_tokens), [{V.quoted(V.TERMS)}])")
def search_comparison(spark, sf_dir) -> DataFrame:
    """Hits of the same terms by a scan of all tokens and by the stored postings; IX.timed tells their seconds."""
    rows = IX.timed(V.stored_postings(spark, sf_dir), V.token_rows(spark, sf_dir), _FIELDS, V.TERMS)
    return spark.createDataFrame([(m, n) for m, n, _ in rows], "method string, hits long")


_RAW = {"ltc": "(1 + ln(tf)) * ln(n / df)", "nfc": "tf * ln(n / df)", "bfx": "ln(n / df)", "tfx": "CAST(tf AS DOUBLE)"}


def _weights(scheme: str) -> None:
    unit = scheme in ("ltc", "nfc")
    w = "w / CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY doc_id)) < 1e-9 THEN 1.0 ELSE sqrt(sum(w * w) OVER (PARTITION BY doc_id)) END" if unit else "w"

    @query(f"{scheme}_weights", f"WITH {V.POST} SELECT term, doc_id, round({w}, 6) AS w FROM (SELECT term, doc_id, {_RAW[scheme]} AS w FROM post JOIN df USING (term), n)")
    def run(spark, sf_dir) -> DataFrame:
        return IX.weights(V.stored_postings(spark, sf_dir), V.n_documents(spark, sf_dir), scheme).withColumn("w", F.round("w", 6))


for _scheme in _RAW:
    _weights(_scheme)


_PARTS = " UNION ALL ".join(f"SELECT count(*) AS stored, round(count(*) / any_value(n), 6) AS avg_per_doc, count(*) FILTER (WHERE abs({w}) > 1e-12) AS non_zero, '{s}' AS scheme FROM post JOIN df USING (term), n" for s, w in _RAW.items())


@query("weight_schemes", f"WITH {V.POST} {_PARTS}")
def weight_schemes(spark, sf_dir) -> DataFrame:
    return IX.scheme_stats(V.stored_postings(spark, sf_dir), V.n_documents(spark, sf_dir))


@query("index_build", f"WITH {V.MATRIX} SELECT (SELECT count(*) FROM matrix) AS weights, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings FROM vocab")
def index_build(spark, sf_dir) -> DataFrame:
    """Builds and writes the search index anew; returns its sizes."""
    ix = V.index(spark, sf_dir, rebuild=True)
    return ix.matrix.agg(F.count(F.lit(1)).alias("weights")).crossJoin(ix.vocabulary.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings")))  # one row each


@query("tfidf_top200", f"WITH {V.MATRIX} SELECT doc_id, term, round(w, 6) AS w FROM matrix")
def tfidf_top200(spark, sf_dir) -> DataFrame:
    return V.index(spark, sf_dir).matrix.withColumn("w", F.round("w", 6))


@query("document_norms", f"WITH {V.MATRIX} SELECT doc_id, round(norm, 6) AS norm FROM norms")
def document_norms(spark, sf_dir) -> DataFrame:
    return V.index(spark, sf_dir).norms.withColumn("norm", F.round("norm", 6))


@query("set_consistency", f"WITH {V.MATRIX}, b AS (SELECT term, v.term IS NOT NULL AS a, df.term IS NOT NULL AS b FROM vocab v FULL JOIN df USING (term)) SELECT count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE NOT b) AS only_a, count(*) FILTER (WHERE NOT a) AS only_b FROM b")
def set_consistency(spark, sf_dir) -> DataFrame:
    return IX.consistency(V.index(spark, sf_dir).vocabulary, IX.document_frequency(V.stored_postings(spark, sf_dir)))


def _cosine_sql(out: str) -> str:
    return f"WITH {V.score_sql(V.TERMS)} {out}"


@query("cosine_search", _cosine_sql("SELECT doc_id, round(cosine, 6) AS cosine FROM cos"))
def cosine_search(spark, sf_dir) -> DataFrame:
    ix = V.index(spark, sf_dir)
    return S.cosine(ix.matrix, S.query_vector(ix.vocabulary, V.TERMS, ix.n_docs), ix.norms).withColumn("cosine", F.round("cosine", 6))


@query("query_vector", _cosine_sql("SELECT term, round(q, 6) AS q FROM q"))
def query_vector(spark, sf_dir) -> DataFrame:
    ix = V.index(spark, sf_dir)
    return S.query_vector(ix.vocabulary, V.TERMS, ix.n_docs).withColumn("q", F.round("q", 6))


_SNIP = """SELECT *, coalesce(nullif(position('that' IN low), 0), nullif(position('with' IN low), 0), nullif(position('this' IN low), 0), 0) AS place FROM (SELECT *, lower(body) AS low FROM {0})"""
_CUT = V.snippet_sql("body", 150)


@query("search_basic", f"WITH {V.score_sql(V.TERMS)}, top AS (SELECT *, {_TOP} AS rank FROM hits ORDER BY rank LIMIT 10) SELECT CAST(rank AS INTEGER) AS rank, doc_id, title, score, {_CUT} AS snippet FROM ({_SNIP.format('top')})")
def search_basic(spark, sf_dir) -> DataFrame:
    hits = S.search(V.index(spark, sf_dir), S.Request(V.TERMS, page_size=10))
    return hits.select("rank", "doc_id", "title", "score", present.snippet(F.col("body"), V.TERMS, mark=False).alias("snippet"))


@query("search_all_hits", f"WITH {V.score_sql(V.TERMS)} SELECT doc_id, score FROM hits")
def search_all_hits(spark, sf_dir) -> DataFrame:
    return S.scored(V.index(spark, sf_dir), S.Request(V.TERMS)).select("doc_id", "score")


@query("search_title_boost", f"WITH {V.score_sql(['the', 'and'])} SELECT doc_id, score FROM hits")
def search_title_boost(spark, sf_dir) -> DataFrame:
    return S.scored(V.index(spark, sf_dir), S.Request(["the", "and"])).select("doc_id", "score")


@query("search_company_bonus", f"WITH {V.score_sql(['that'], 'src1 that')} SELECT doc_id, company, score FROM hits")
def search_company_bonus(spark, sf_dir) -> DataFrame:
    return S.scored(V.index(spark, sf_dir), S.Request(["that"], "src1 that")).select("doc_id", "company", "score")


@query("search_filtered_sorted_paged", f"""WITH {V.score_sql(V.TERMS, where="contains(industry, 'en') AND salary_min >= 500 AND salary_max <= 20000 AND NOT contains(title, 'there') AND NOT contains(body, 'there')")}
SELECT doc_id, score, salary_max, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY salary_max DESC, doc_id) AS rank FROM hits) WHERE rank BETWEEN 11 AND 20""")
def search_filtered_sorted_paged(spark, sf_dir) -> DataFrame:
    r = S.Request(V.TERMS, filters=Filters(industry="en", salary_min=500, salary_max=20000, exclude="there"), sort_by="salary_max", page=2, page_size=10)
    return S.search(V.index(spark, sf_dir), r).select("doc_id", "score", "salary_max", "rank")


def _no_terms(spark, sf_dir) -> S.Index:
    docs = V.jobs(spark, sf_dir)
    return S.Index(docs, None, None, None, None, 0)


_RULES = "contains(industry, 'BUILD') AND contains(education, 'URGENT') AND contains(experience, 'F') AND salary_min >= 1000 AND pub_date >= DATE '1995-01-01' AND pub_date <= DATE '1998-06-30'"


@query("filter_conjunction", f"WITH {V.JOB} SELECT doc_id, 50.0::DOUBLE AS score FROM job WHERE {_RULES}")
def filter_conjunction(spark, sf_dir) -> DataFrame:
    rules = Filters(industry="BUILD", education="URGENT", experience="F", salary_min=1000, date_from="1995-01-01", date_to="1998-06-30")
    return S.scored(_no_terms(spark, sf_dir), S.Request([], filters=rules)).select("doc_id", "score")


@query("filter_city", f"WITH {V.JOB} SELECT doc_id, city FROM job WHERE city = 'NATION_1' AND salary_max <= 300000")
def filter_city(spark, sf_dir) -> DataFrame:
    rules = Filters(city="NATION_1", salary_max=300000)
    return S.scored(_no_terms(spark, sf_dir), S.Request([], filters=rules)).select("doc_id", "city")


@query("merged_filters", f"WITH {V.JOB} SELECT doc_id, city, education FROM job WHERE city = 'NATION_2' AND contains(education, 'HIGH') AND salary_min >= 20000")
def merged_filters(spark, sf_dir) -> DataFrame:
    """What a query says and what is asked for beside it: the explicit filter wins."""
    service = SV.Service(_no_terms(spark, sf_dir), Q.Vocabulary(["NATION_1", "NATION_2"]))
    r, _ = service.request("NATION_1 20k+", Filters(city="NATION_2", education="HIGH"))
    return S.scored(_no_terms(spark, sf_dir), S.Request([], filters=r.filters)).select("doc_id", "city", "education")


for _key, _order in {"date": "pub_date DESC", "salary_min": "salary_min DESC", "relevance": "score DESC, pub_date DESC", "unknown": "0"}.items():

    @query(f"sort_by_{_key}", f"WITH {V.JOB}, hits AS (SELECT *, 50.0 AS score FROM job) SELECT doc_id, pub_date, salary_min, CAST(row_number() OVER (ORDER BY {_order}, doc_id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 20")
    def _sorted(spark, sf_dir, key=_key) -> DataFrame:
        return S.search(_no_terms(spark, sf_dir), S.Request([], sort_by=key)).select("doc_id", "pub_date", "salary_min", "rank")


@query("facets", f"""WITH {V.JOB}, c AS (SELECT 'industry' AS field, industry AS value, count(*) AS n FROM job GROUP BY industry UNION ALL SELECT 'city', city, count(*) FROM job GROUP BY city
UNION ALL SELECT 'education', education, count(*) FROM job GROUP BY education UNION ALL SELECT 'experience', experience, count(*) FROM job GROUP BY experience)
SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rk FROM c) WHERE rk <= 30 OR field IN ('education', 'experience')""")
def facets(spark, sf_dir) -> DataFrame:
    return S.facets(V.jobs(spark, sf_dir))


_PAIRS = "unit AS (SELECT doc_id, term, w / norm AS u FROM matrix JOIN norms USING (doc_id)), pairs AS (SELECT a.doc_id AS i, b.doc_id AS j, round(sum(a.u * b.u), 6) AS score FROM unit a JOIN unit b USING (term) WHERE a.doc_id <> b.doc_id {0} GROUP BY ALL)"
_BEST = "SELECT i, j, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS rank FROM pairs WHERE score > 0) WHERE rank <= 5"


@query("similar_items", f"WITH {V.MATRIX}, {_PAIRS.format('')} {_BEST}")
def similar_items(spark, sf_dir) -> DataFrame:
    ix = V.index(spark, sf_dir)
    return S.similar_blocked(ix.matrix, ix.norms).select("i", "j", "score", "rank")


@query("similar_to_one", f"WITH {V.MATRIX}, {_PAIRS.format('AND a.doc_id = 7')} {_BEST}")
def similar_to_one(spark, sf_dir) -> DataFrame:
    ix = V.index(spark, sf_dir)
    return S.top_similar(S.similar_pairs(ix.matrix, ix.norms, [7])).select("i", "j", "score", "rank")


@query("similar_records", f"WITH {V.MATRIX}, {_PAIRS.format('AND a.doc_id = 7')}, best AS ({_BEST}) SELECT rank, round(score, 4) AS score, doc_id, title, company FROM best JOIN rec ON j = doc_id")
def similar_records(spark, sf_dir) -> DataFrame:
    ix = V.index(spark, sf_dir)
    best = S.top_similar(S.similar_pairs(ix.matrix, ix.norms, [7]))
    return S.similar_records(best, S.record_view(ix.docs), 7).select("rank", "score", "doc_id", "title", "company")


_VIEW = "doc_id, title, company, industry, city, education, experience, category, body, CAST(trunc(salary_min) AS BIGINT) AS salary_min, CAST(trunc(salary_max) AS BIGINT) AS salary_max, strftime(pub_date, '%Y-%m-%d') AS pub_date, strftime(end_date, '%Y-%m-%d') AS end_date"


@query("record_view", f"WITH {V.JOB} SELECT {_VIEW} FROM job")
def record_view(spark, sf_dir) -> DataFrame:
    return S.record_view(V.jobs(spark, sf_dir)).drop("keywords")


@query("records_in_order", f"WITH {V.JOB}, asked AS (SELECT unnest([5, 3, -1, 3]) AS asked, CAST(unnest(range(4)) AS INTEGER) AS \"at\") SELECT \"at\", CAST(asked AS BIGINT) AS asked, title, company FROM asked LEFT JOIN job ON asked = doc_id")
def records_in_order(spark, sf_dir) -> DataFrame:
    return S.records(S.record_view(V.jobs(spark, sf_dir)), [5, 3, -1, 3]).select("at", "asked", "title", "company")


@query("latest_cards", f"WITH {V.JOB} SELECT doc_id, title, company, city, CAST(CAST(floor(salary_min / 1000) AS BIGINT) AS VARCHAR) || 'k-' || CAST(CAST(floor(salary_max / 1000) AS BIGINT) AS VARCHAR) || 'k' AS salary, strftime(pub_date, '%Y-%m-%d') AS pub_date FROM job ORDER BY job.pub_date DESC, doc_id LIMIT 8")
def latest_cards(spark, sf_dir) -> DataFrame:
    return SV.latest(V.jobs(spark, sf_dir))


@query("service_counts", f"WITH {V.JOB} SELECT count(*) AS jobs, count(DISTINCT industry) AS industries, count(DISTINCT city) AS cities, count(DISTINCT company) AS companies FROM job")
def service_counts(spark, sf_dir) -> DataFrame:
    return SV.Service(_no_terms(spark, sf_dir)).counts()


_GEO = ", ".join(f"('{c}', {x}, {y})" for c, x, y in (("NATION_3", 2.35, 48.85), ("NATION_7", 13.4, 52.52), ("NATION_12", 139.69, 35.68), ("NOWHERE", 0.0, 0.0), ("NATION_20", -47.88, -15.79)))


@query("geo_join", f"WITH {V.JOB}, geo(city, lng, lat) AS (VALUES {_GEO}), c AS (SELECT city, count(*) AS n FROM job GROUP BY city), m AS (SELECT city, n, CAST(lng AS DOUBLE) AS lng, CAST(lat AS DOUBLE) AS lat FROM c JOIN geo USING (city)) SELECT *, round(greatest(4 + (n - min(n) OVER ()) / greatest(max(n) OVER () - min(n) OVER (), 1) * 28, 4.0), 4) AS symbol_size FROM m")
def geo_join(spark, sf_dir) -> DataFrame:
    geo = spark.createDataFrame([("NATION_3", 2.35, 48.85), ("NATION_7", 13.4, 52.52), ("NATION_12", 139.69, 35.68), ("NOWHERE", 0.0, 0.0), ("NATION_20", -47.88, -15.79)], "city string, lng double, lat double")
    return SV.Service(_no_terms(spark, sf_dir)).map_data(geo)


@query("service_statistics", f"WITH {V.JOB} SELECT 'industry' AS field, value, n FROM (SELECT industry AS value, count(*) AS n FROM job GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 9) UNION ALL SELECT 'city', value, n FROM (SELECT city AS value, count(*) AS n FROM job GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) UNION ALL SELECT 'education', education, count(*) FROM job GROUP BY 2 UNION ALL SELECT 'experience', experience, count(*) FROM job GROUP BY 2")
def service_statistics(spark, sf_dir) -> DataFrame:
    return SV.Service(_no_terms(spark, sf_dir)).statistics()["categories"]


@query("salary_bins", f"WITH {V.JOB}, e AS (SELECT unnest([0.01, 5000, 8000, 10000, 15000, 20000, 30000, 50000]) AS low, CAST(unnest(range(8)) AS INTEGER) AS bin), b AS (SELECT bin, CAST(low AS DOUBLE) AS low, CAST(lead(low) OVER (ORDER BY bin) AS DOUBLE) AS high FROM e) SELECT bin, low, high, (SELECT count(*) FROM job WHERE salary_min > 0 AND salary_max > 0 AND (salary_min + salary_max) / 2 >= low AND (high IS NULL OR (salary_min + salary_max) / 2 < high)) AS n FROM b")
def salary_bins(spark, sf_dir) -> DataFrame:
    return SV.Service(_no_terms(spark, sf_dir)).statistics()["salaries"]


@query("result_cards", f"WITH {V.score_sql(V.TERMS)}, top AS (SELECT *, {_TOP} AS rank FROM hits ORDER BY rank LIMIT 20) SELECT CAST(rank AS INTEGER) AS rank, doc_id, score, company, industry, city FROM top")
def result_cards(spark, sf_dir) -> DataFrame:
    hits = S.search(V.index(spark, sf_dir), S.Request(V.TERMS))
    return SV.cards(hits, V.TERMS).select("rank", "doc_id", "score", "company", "industry", "city")


@query("share_of_total", f"WITH {V.JOB}, c AS (SELECT industry AS value, count(*) AS n FROM job GROUP BY industry) SELECT value, n, round(100.0 * n / sum(n) OVER (), 4) AS share FROM c")
def share_of_total(spark, sf_dir) -> DataFrame:
    return P.with_share(P.value_counts(V.jobs(spark, sf_dir), "industry"))


@query("preview_rows", f"WITH {V.JOB} SELECT company, title, city, salary_min FROM job ORDER BY doc_id LIMIT 3")
def preview_rows(spark, sf_dir) -> DataFrame:
    return readers.preview(V.jobs(spark, sf_dir), "doc_id", ["company", "title", "city", "salary_min"])


@query("record_keywords", f"WITH {KEYWORDS} SELECT rec.doc_id, title, coalesce(list, '') AS keywords FROM rec LEFT JOIN (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS list FROM kw WHERE rank <= 10 GROUP BY doc_id) USING (doc_id)")
def record_keywords(spark, sf_dir) -> DataFrame:
    """Every record with its keywords, none where it has no tokens."""
    view = S.record_view(V.records(spark, sf_dir), K.as_lists(K.tfidf(V.token_rows(spark, sf_dir))))
    return view.select("doc_id", "title", F.array_join("keywords", " ").alias("keywords"))

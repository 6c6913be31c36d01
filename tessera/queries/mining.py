"""Term statistics, keywords, graph ranking, word vectors and clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cluster as C
from tessera.operators import keywords as K
from tessera.operators import profile as P
from tessera.operators import ranking as R
from tessera.operators import search as S
from tessera.queries import views as V
from tessera.registry import query
from tessera.session import materialise

_FREQ = f"{V.TOK}, words AS (SELECT doc_id, unnest(body_tokens) AS term FROM tok), freq AS (SELECT term, count(*) AS freq FROM words GROUP BY term), ranked AS (SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) AS rank, sum(freq) OVER () AS total FROM freq)"


def frequencies(spark, sf_dir) -> DataFrame:
    words = V.token_rows(spark, sf_dir).select(F.explode("body_tokens").alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


@query("term_freq_rank", f"WITH {_FREQ} SELECT term, freq, CAST(rank AS BIGINT) AS rank, round(freq / total, 9) AS share FROM ranked")
def term_freq_rank(spark, sf_dir) -> DataFrame:
    return P.ranked_terms(frequencies(spark, sf_dir))


@query("zipf_fit", f"WITH {_FREQ}, f AS (SELECT regr_slope(log10(freq), log10(rank)) AS s, regr_intercept(log10(freq), log10(rank)) AS i, regr_r2(log10(freq), log10(rank)) AS r FROM ranked) SELECT round(s, 6) AS slope, round(i, 6) AS intercept, round(r, 6) AS r2, round(abs(s + 1), 6) AS deviation FROM f")
def zipf_fit(spark, sf_dir) -> DataFrame:
    return P.zipf_fit(P.ranked_terms(frequencies(spark, sf_dir)))


@query("hapax", f"WITH {_FREQ} SELECT count(*) FILTER (WHERE freq = 1) AS hapax, round(100.0 * count(*) FILTER (WHERE freq = 1) / count(*), 4) AS share, count(*) AS types, CAST(sum(freq) AS BIGINT) AS tokens FROM freq")
def hapax(spark, sf_dir) -> DataFrame:
    return P.hapax(frequencies(spark, sf_dir))


@query("bigram_counts", f'WITH {V.TOK}, w AS (SELECT doc_id, unnest(body_tokens) AS term, unnest(range(len(body_tokens))) AS pos FROM tok), p AS (SELECT lag(term) OVER (PARTITION BY doc_id ORDER BY pos) AS "left", term AS "right" FROM w) SELECT "left", "right", count(*) AS n FROM p WHERE "left" IS NOT NULL GROUP BY 1, 2')
def bigram_counts(spark, sf_dir) -> DataFrame:
    words = V.token_rows(spark, sf_dir).select(F.col("doc_id").alias("line"), F.posexplode("body_tokens").alias("pos", "word"))
    return R.adjacent_pairs(words)


TFIDF = f"""{V.TOK},
kdoc AS (SELECT * FROM tok WHERE len(body_tokens) > 0),
ktf AS (SELECT doc_id, term, sum(one) AS tf FROM (SELECT doc_id, unnest(title_tokens) AS term, 2.0::DOUBLE AS one FROM kdoc UNION ALL SELECT doc_id, unnest(body_tokens), 1.0::DOUBLE FROM kdoc) GROUP BY ALL),
kdf AS (SELECT term, count(*) AS df FROM ktf GROUP BY term),
kscore AS (SELECT doc_id, term, tf * ln((SELECT count(*) FROM kdoc) / (df + 1)) AS score FROM ktf JOIN kdf USING (term)),
kw AS (SELECT doc_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS rank FROM kscore) WHERE rank <= 30)"""


def _tokens(spark, sf_dir) -> DataFrame:
    return V.token_rows(spark, sf_dir)


@query("tfidf_keywords", f"WITH {TFIDF} SELECT doc_id, term, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kw WHERE rank <= 10")
def tfidf_keywords(spark, sf_dir) -> DataFrame:
    return K.tfidf(_tokens(spark, sf_dir)).select("doc_id", "term", F.round("score", 6).alias("score"), "rank")


@query("keyword_candidates", f"WITH {TFIDF} SELECT doc_id, term, CAST(rank AS INTEGER) AS rank FROM kw")
def keyword_candidates(spark, sf_dir) -> DataFrame:
    return K.tfidf(_tokens(spark, sf_dir), K.CANDIDATES).select("doc_id", "term", "rank")


_EDGES = """kocc AS (SELECT o.doc_id, o.term, o.pos FROM (SELECT doc_id, unnest(list_concat(title_tokens, body_tokens)) AS term, unnest(range(len(title_tokens) + len(body_tokens))) AS pos FROM kdoc) o SEMI JOIN kw USING (doc_id, term)),
edges AS (SELECT a.doc_id, least(a.term, b.term) AS src, greatest(a.term, b.term) AS dst, count(*) AS weight FROM kocc a JOIN kocc b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 AND a.term <> b.term GROUP BY ALL)"""


@query("cooccurrence_edges", f"WITH {TFIDF}, {_EDGES} SELECT * FROM edges")
def cooccurrence_edges(spark, sf_dir) -> DataFrame:
    t = _tokens(spark, sf_dir)
    return K.cooccurrence(t, K.tfidf(t, K.CANDIDATES))


def _graph_ranked(spark, sf_dir) -> DataFrame:
    t = _tokens(spark, sf_dir)
    candidates = materialise(K.tfidf(t, K.CANDIDATES))
    return K.textrank(candidates, K.cooccurrence(t, candidates))


_ROUNDS = 50
_RANK = f"""node AS (SELECT doc_id, term, count(*) OVER (PARTITION BY doc_id) AS n FROM kw),
arc AS (SELECT doc_id, src AS a, dst AS b, weight FROM edges UNION ALL SELECT doc_id, dst, src, weight FROM edges),
flow AS (SELECT doc_id, a, b, weight / sum(weight) OVER (PARTITION BY doc_id, a) AS share FROM arc),
rank_(round_, doc_id, terms, x) AS (
  SELECT 0, doc_id, list(term ORDER BY term), list(1.0::DOUBLE / n ORDER BY term) FROM node GROUP BY doc_id UNION ALL
  SELECT r.round_ + 1, r.doc_id, r.terms, list_transform(r.terms, lambda t, i: {K.DAMPING} * (coalesce(list_sum(list_transform(list_filter(g.arcs, lambda e: e.b = t), lambda e: e.share * r.x[list_position(r.terms, e.a)])), 0)
    + coalesce(list_sum(list_transform(list_filter(r.terms, lambda u: NOT list_contains(g.bound, u)), lambda u: r.x[list_position(r.terms, u)])), 0) / len(r.terms)) + {1 - K.DAMPING} / len(r.terms))
  FROM rank_ r JOIN graph g USING (doc_id) WHERE r.round_ < {_ROUNDS}),
final AS (SELECT doc_id, unnest(terms) AS term, unnest(x) AS score FROM rank_ WHERE round_ = {_ROUNDS}),
tr AS (SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS rank FROM final QUALIFY rank <= 10)"""
_GRAPH = "graph AS (SELECT d.doc_id, coalesce(list({{'a': a, 'b': b, 'share': share}}) FILTER (WHERE a IS NOT NULL), []) AS arcs, coalesce(list(DISTINCT a) FILTER (WHERE a IS NOT NULL), []) AS bound FROM (SELECT DISTINCT doc_id FROM node) d LEFT JOIN flow USING (doc_id) GROUP BY d.doc_id)"
_TEXTRANK = f"{TFIDF}, {_EDGES}, " + _RANK.replace("rank_(round_", _GRAPH.format() + ",\nrank_(round_")


@query("textrank_keywords", f"WITH RECURSIVE {_TEXTRANK} SELECT doc_id, term, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM tr")
def textrank_keywords(spark, sf_dir) -> DataFrame:
    return _graph_ranked(spark, sf_dir).select("doc_id", "term", F.round("score", 6).alias("score"), "rank")


_PLAIN = TFIDF.replace("2.0::DOUBLE AS one", "1.0::DOUBLE AS one")
_LISTS = f"""{_TEXTRANK},
tf_list AS (SELECT doc_id, list(term ORDER BY rank) AS keywords FROM kw WHERE rank <= 10 GROUP BY doc_id),
tr_list AS (SELECT doc_id, list(term ORDER BY rank) AS keywords FROM tr GROUP BY doc_id)"""


def _two_lists(spark, sf_dir) -> dict[str, DataFrame]:
    return {"tfidf": K.as_lists(K.tfidf(_tokens(spark, sf_dir))), "textrank": K.as_lists(_graph_ranked(spark, sf_dir))}


@query("keyword_pooling", f"WITH RECURSIVE {_LISTS} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(a.keywords, b.keywords))), ' ') AS keywords FROM tf_list a JOIN tr_list b USING (doc_id)")
def keyword_pooling(spark, sf_dir) -> DataFrame:
    lists = _two_lists(spark, sf_dir)
    return K.pool(lists["tfidf"], lists["textrank"]).select("doc_id", F.array_join("keywords", " ").alias("keywords"))


_F1 = "(SELECT coalesce(round(avg(CASE WHEN h > 0 THEN 2 * (h / p) * (h / g) / (h / p + h / g) ELSE 0 END), 6), 0) FROM (SELECT len(list_intersect(l.keywords, gold.g)) AS h, len(l.keywords) AS p, len(gold.g) AS g FROM {0} l JOIN gold USING (doc_id)))"


@query("best_keyword_export", f"WITH RECURSIVE {_LISTS}, gold AS (SELECT doc_id, list_sort(list_distinct(title_tokens))[1:8] AS g FROM tok WHERE len(title_tokens) > 0), pick AS (SELECT {_F1.format('textrank')} > {_F1.format('tfidf')} AS textrank)".replace("FROM textrank l", "FROM tr_list l").replace("FROM tfidf l", "FROM tf_list l") + " SELECT doc_id, CASE WHEN textrank THEN 'textrank' ELSE 'tfidf' END AS method, array_to_string(CASE WHEN textrank THEN b.keywords ELSE a.keywords END, ' ') AS keywords FROM tf_list a JOIN tr_list b USING (doc_id), pick")
def best_keyword_export(spark, sf_dir) -> DataFrame:
    """The lists of the method that is nearer to gold sets (here the first words of the titles in the order of the alphabet)."""
    titles = _tokens(spark, sf_dir).where("size(title_tokens) > 0")
    gold = titles.select("doc_id", F.slice(_in_order("title_tokens"), 1, 8).alias("gold"))
    lists = {name: materialise(own) for name, own in _two_lists(spark, sf_dir).items()}
    name, best = K.best_lists(lists, gold)
    return best.select("doc_id", F.lit(name).alias("method"), F.array_join("keywords", " ").alias("keywords"))


def _in_order(column: str):
    return F.array_sort(F.array_distinct(column))


@query("keyword_evaluation", f"""WITH a AS (WITH {TFIDF} SELECT doc_id, list(term) AS p FROM kw WHERE rank <= 10 GROUP BY doc_id), b AS (WITH {_PLAIN} SELECT doc_id, list(term) AS g FROM kw WHERE rank <= 5 GROUP BY doc_id),
m AS (SELECT len(list_intersect(p, g)) / len(p) AS p, len(list_intersect(p, g)) / len(g) AS r FROM a JOIN b USING (doc_id))
SELECT count(*) AS n, round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM m""")
def keyword_evaluation(spark, sf_dir) -> DataFrame:
    t = _tokens(spark, sf_dir)
    gold = K.as_lists(K.tfidf(t, 5, title_weight=1.0), 5).withColumnRenamed("keywords", "gold")
    return K.evaluate(K.as_lists(K.tfidf(t)), gold)


@query("keywords_by_dimension", f"WITH {TFIDF}, c AS (SELECT industry AS value, term, count(*) AS n FROM kw JOIN rec USING (doc_id) WHERE rank <= 10 AND trim(industry) <> '' GROUP BY ALL) SELECT value, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 20")
def keywords_by_dimension(spark, sf_dir) -> DataFrame:
    return K.by_dimension(K.as_lists(K.tfidf(_tokens(spark, sf_dir))), V.records(spark, sf_dir), "industry")


_VARIANCE = f"{V.MATRIX}, var AS (SELECT term, count(*) AS df, round(sum(w * w) / any_value(n) - power(sum(w) / any_value(n), 2), 9) AS variance FROM matrix, n GROUP BY term HAVING count(*) >= 10 ORDER BY variance DESC, term LIMIT 800)"


def _matrix(spark, sf_dir) -> tuple[DataFrame, int]:
    ix = V.index(spark, sf_dir)
    return ix.matrix, ix.n_docs


@query("word_variance_select", f"WITH {_VARIANCE} SELECT term, df, round(variance, 6) AS variance FROM var")
def word_variance_select(spark, sf_dir) -> DataFrame:
    return C.word_variance(*_matrix(spark, sf_dir)).withColumn("variance", F.round("variance", 6))


@query("word_vectors", f"WITH {_VARIANCE} SELECT term, doc_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY term)), 6) AS w FROM matrix SEMI JOIN var USING (term)")
def word_vectors(spark, sf_dir) -> DataFrame:
    matrix, n = _matrix(spark, sf_dir)
    return C.word_vectors(matrix, C.word_variance(matrix, n)).withColumn("w", F.round("w", 6))


def _words(spark, sf_dir) -> C.Words:
    def make() -> C.Words:
        matrix, n = _matrix(spark, sf_dir)
        return C.Words.of(C.word_vectors(matrix, C.word_variance(matrix, n)))

    return V.stored(spark, sf_dir, "words", make)


def _clusterings(spark, sf_dir) -> dict[str, np.ndarray]:
    """k-means at the k of best silhouette, and the three linkages at that k."""

    def make() -> dict[str, np.ndarray]:
        words = _words(spark, sf_dir)
        labels, k = C.kmeans(words)
        return {"kmeans": labels} | {m: C.hierarchical(words, k, m) for m in ("ward", "single", "complete")}

    return V.stored(spark, sf_dir, "clusterings", make)


def _labels(spark, sf_dir, *methods: str) -> DataFrame:
    words, runs = _words(spark, sf_dir), _clusterings(spark, sf_dir)
    return reduce(DataFrame.unionByName, (words.labelled(runs[m]).withColumn("method", F.lit(m)) for m in methods))


@query("kmeans_words")
def kmeans_words(spark, sf_dir) -> DataFrame:
    return _labels(spark, sf_dir, "kmeans").select("term", "cluster")


@query("hierarchical_words")
def hierarchical_words(spark, sf_dir) -> DataFrame:
    """Ward, single and complete linkage at the k that k-means chooses by silhouette."""
    return _labels(spark, sf_dir, "ward", "single", "complete").select("term", "method", "cluster")


@query("word_cluster_quality")
def word_cluster_quality(spark, sf_dir) -> DataFrame:
    """Size and mean cosine inside each cluster of the words."""
    matrix, n = _matrix(spark, sf_dir)
    vectors = C.word_vectors(matrix, C.word_variance(matrix, n)).select(F.col("term").alias("item"), F.col("doc_id").alias("dim"), "w")
    labels = _labels(spark, sf_dir, "kmeans").select(F.col("term").alias("item"), "cluster")
    return C.quality(vectors, F.broadcast(labels))[0]  # at most WORDS rows


@query("word_cluster_overlap")
def word_cluster_overlap(spark, sf_dir) -> DataFrame:
    """How far the four clusterings of the words agree, pair by pair."""
    return C.overlap(_labels(spark, sf_dir, "kmeans", "ward", "single", "complete").withColumnRenamed("term", "item"))


@query("pca_2d")
def pca_2d(spark, sf_dir) -> DataFrame:
    """Coordinates of the words, and the shares of variance of both axes."""
    words = _words(spark, sf_dir)
    xy, shares = C.pca(words)
    rows = [(t, round(float(a), 6), round(float(b), 6), *(round(s, 6) for s in shares)) for t, (a, b) in zip(words.terms, xy, strict=True)]
    return spark.createDataFrame(rows, "term string, x double, y double, share_x double, share_y double")


_EMB = """e AS (SELECT vec_id AS item, label AS cluster, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT item, cluster, unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS w, unnest(range(len(v))) AS dim FROM e),
s AS (SELECT cluster, dim, sum(w) AS s FROM u GROUP BY ALL),
sq AS (SELECT cluster, sum(s * s) AS square FROM s GROUP BY cluster),
sz AS (SELECT cluster, count(*) AS size FROM e GROUP BY cluster),
own AS (SELECT cluster, sum(w * w) AS self FROM u GROUP BY cluster),
per AS (SELECT cluster, size, round(CASE WHEN size > 1 THEN (square - self) / (size * (size - 1)) ELSE 0 END, 6) AS intra FROM sz JOIN own USING (cluster) JOIN sq USING (cluster))"""


def _quality(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = V.table(spark, sf_dir, "embeddings")
    return C.quality(C.vectors_of_embeddings(df, "vec_id", "embedding"), df.select(F.col("vec_id").alias("item"), F.col("label").alias("cluster")))


@query("cluster_quality", f"WITH {_EMB} SELECT * FROM per")
def cluster_quality(spark, sf_dir) -> DataFrame:
    return _quality(spark, sf_dir)[0]


@query("cluster_separation", f"WITH {_EMB}, t AS (SELECT sum(s / sqrt(square)) AS t FROM s JOIN sq USING (cluster) GROUP BY dim), k AS (SELECT count(*) AS k FROM sz) SELECT (SELECT round(avg(intra), 6) FROM per WHERE size > 1) AS intra, round(1 - (sum(t * t) - any_value(k)) / (any_value(k) * (any_value(k) - 1)), 6) AS inter FROM t, k")
def cluster_separation(spark, sf_dir) -> DataFrame:
    return _quality(spark, sf_dir)[1]


_SIGNS = "(CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END)"


def _sign_clusters(spark, sf_dir) -> DataFrame:
    """Clusters of the embeddings by the signs of their first two numbers, which SQL can say too."""
    positive = [F.when(F.col("embedding")[k] > 0, 1 << k).otherwise(0) for k in (0, 1)]
    return V.table(spark, sf_dir, "embeddings").select("vec_id", (positive[0] + positive[1]).alias("cluster"), "label")


@query("cluster_agreement", f"WITH c AS (SELECT {_SIGNS} AS cluster, label, count(*) AS n FROM embeddings GROUP BY ALL), p AS (SELECT cluster, max(n) AS most, sum(n) AS size, -sum(n / t * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY cluster) AS t FROM c) GROUP BY cluster) SELECT round(sum(most) / sum(size), 6) AS purity, round(sum(h * size) / sum(size), 6) AS entropy FROM p")
def cluster_agreement(spark, sf_dir) -> DataFrame:
    return C.agreement(_sign_clusters(spark, sf_dir).select("cluster", "label"))


@query("cluster_overlap", f"WITH c AS (SELECT label AS x, {_SIGNS} AS y, count(*) AS n FROM embeddings GROUP BY ALL) SELECT 'label' AS a, 'signs' AS b, round(sum(most) / sum(size), 6) AS overlap FROM (SELECT max(n) AS most, sum(n) AS size FROM c GROUP BY x)")
def cluster_overlap(spark, sf_dir) -> DataFrame:
    rows = _sign_clusters(spark, sf_dir)
    two = F.array(F.struct(F.lit("label").alias("method"), F.col("label").cast("int").alias("cluster")), F.struct(F.lit("signs").alias("method"), F.col("cluster").alias("cluster")))
    return C.overlap(rows.select(F.col("vec_id").alias("item"), F.explode(two).alias("x")).select("item", "x.*"))


@query("cluster_names", "SELECT label AS cluster, count(*) AS size, array_to_string(list_sort(list('v' || vec_id))[1:3], ' · ') AS name FROM embeddings GROUP BY label")
def cluster_names(spark, sf_dir) -> DataFrame:
    df = V.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("term"))
    return C.names(df)


@query("embedding_neighbours", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e), p AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])), 6) AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT i, j, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS rank FROM p WHERE score > 0) WHERE rank <= 5")
def embedding_neighbours(spark, sf_dir) -> DataFrame:
    unit = C.vectors_of_embeddings(V.table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.col("item").alias("doc_id"), F.col("dim").cast("string").alias("term"), F.col("w").alias("u"))
    asked = unit.where("doc_id % 20 = 0").withColumn("side", F.lit(0))
    near = S.best_products(asked.unionByName(unit.withColumn("side", F.lit(1))), 6)
    return S.top_similar(near.where("i <> j")).select("i", "j", "score", "rank")

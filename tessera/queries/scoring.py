"""Retrieval metrics, and classification by KNN and naive Bayes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import classify as C
from tessera.operators import evaluate as E
from tessera.operators import sampling as SA
from tessera.queries import views as V
from tessera.registry import query
from tessera.session import materialise, shared_dir

_RUN = """j AS (SELECT CAST(o_custkey % 100 AS INTEGER) AS query_id, o_orderkey AS rank, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rel FROM orders),
kept AS (SELECT query_id, rank, rel FROM j WHERE rel IS NOT NULL AND query_id IN (SELECT query_id FROM j GROUP BY 1 HAVING sum(rel) > 0)),
run AS (SELECT *, row_number() OVER w AS place, sum(rel) OVER w AS hits, sum(rel) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM kept WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
m AS (SELECT query_id, CAST(any_value(total) AS BIGINT) AS n_rel, round(sum(rel) FILTER (WHERE place <= 5) / 5, 6) AS p_at_5, round(sum(rel) FILTER (WHERE place <= 10) / 10, 6) AS p_at_10, round(avg(hits / place) FILTER (WHERE rel = 1), 6) AS ap,
  round(sum(rel) FILTER (WHERE place <= total) / any_value(total), 6) AS r_precision, round(sum(CASE WHEN place <= 10 THEN rel / log2(place + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END), 6) AS ndcg FROM run GROUP BY query_id)"""


def _judged(spark, sf_dir) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    rel = F.when(F.col("o_orderkey") % 17 == 0, None).when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return E.judged(o.select((F.col("o_custkey") % 100).cast("int").alias("query_id"), F.col("o_orderkey").alias("rank"), rel.alias("rel")))


@query("retrieval_metrics", f"WITH {_RUN} SELECT * FROM m")
def retrieval_metrics(spark, sf_dir) -> DataFrame:
    return E.per_query(_judged(spark, sf_dir))


for _metric in ("p_at_5", "p_at_10", "ap", "ndcg", "r_precision"):

    @query({"ap": "average_precision", "p_at_5": "precision_at_5", "p_at_10": "precision_at_10"}.get(_metric, _metric), f"WITH {_RUN} SELECT query_id, {_metric} FROM m")
    def _one(spark, sf_dir, metric=_metric) -> DataFrame:
        return E.per_query(_judged(spark, sf_dir)).select("query_id", metric)


@query("mean_metrics", f"WITH {_RUN} SELECT count(*) AS n_queries, round(avg(p_at_5), 6) AS p_at_5, round(avg(p_at_10), 6) AS p_at_10, round(avg(ap), 6) AS map, round(avg(r_precision), 6) AS r_precision, round(avg(ndcg), 6) AS ndcg FROM m")
def mean_metrics(spark, sf_dir) -> DataFrame:
    return E.averages(E.per_query(_judged(spark, sf_dir)))


_CURVE = f"{_RUN}, lv AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS level), curve AS (SELECT query_id, level, round(coalesce(max(hits / place) FILTER (WHERE hits / total >= level - 1e-9), 0), 6) AS precision FROM run, lv GROUP BY ALL)"


@query("pr_curve_11", f"WITH {_CURVE} SELECT query_id, level, precision FROM curve")
def pr_curve_11(spark, sf_dir) -> DataFrame:
    return E.interpolated(_judged(spark, sf_dir))


@query("mean_pr_curve", f"WITH {_CURVE} SELECT level, round(avg(precision), 6) AS precision FROM curve GROUP BY level")
def mean_pr_curve(spark, sf_dir) -> DataFrame:
    return E.mean_curve(E.interpolated(_judged(spark, sf_dir)))


@query("confusion_at_10", f"WITH {_RUN} SELECT query_id, CAST(sum(rel) FILTER (WHERE place <= 10) AS BIGINT) AS retrieved_relevant, CAST(10 - sum(rel) FILTER (WHERE place <= 10) AS BIGINT) AS retrieved_nonrelevant, CAST(any_value(total) - sum(rel) FILTER (WHERE place <= 10) AS BIGINT) AS missed_relevant FROM run GROUP BY query_id")
def confusion_at_10(spark, sf_dir) -> DataFrame:
    return E.two_by_two(_judged(spark, sf_dir))


_SPLIT = f"""{V.TOK},
lab AS (SELECT doc_id, CAST(quality AS INTEGER) AS label FROM labels),
spl AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8) AS is_train FROM lab)"""
_VEC = f"""{_SPLIT},
ctf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(body_tokens) AS term FROM tok SEMI JOIN spl USING (doc_id)) GROUP BY ALL),
cdf AS (SELECT term, count(*) AS df FROM ctf JOIN spl USING (doc_id) WHERE is_train GROUP BY term),
cs AS (SELECT doc_id, term, tf * ln((SELECT count(*) FROM spl WHERE is_train) / (coalesce(df, 0) + 1)) AS w FROM ctf LEFT JOIN cdf USING (term)),
vec AS (SELECT doc_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rk FROM cs) WHERE rk <= 200)"""
_NB = f"""{_VEC},
cnt AS (SELECT label, term, count(DISTINCT doc_id) AS n FROM vec JOIN spl USING (doc_id) WHERE is_train GROUP BY ALL),
tot AS (SELECT label, docs, coalesce(total, 0) AS total FROM (SELECT label, count(*) AS docs FROM spl WHERE is_train GROUP BY label) LEFT JOIN (SELECT label, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY label) USING (label)),
sz AS (SELECT count(DISTINCT term) AS v FROM cnt),
pairs AS (SELECT v.doc_id, v.term, t.label, t.total, c.n, v.term IN (SELECT term FROM cnt) AS known FROM vec v JOIN spl s ON v.doc_id = s.doc_id AND NOT is_train CROSS JOIN tot t LEFT JOIN cnt c ON c.term = v.term AND c.label = t.label),
nbs AS (SELECT doc_id, label, round(sum(CASE WHEN known THEN ln((coalesce(n, 0) + 0.1) / (total + 0.1 * (SELECT v FROM sz))) ELSE -ln((SELECT v FROM sz)) END) + (SELECT ln(docs / (SELECT sum(docs) FROM tot)) FROM tot t WHERE t.label = pairs.label), 9) AS score FROM pairs GROUP BY doc_id, label),
nbp AS (SELECT doc_id, label AS predicted FROM nbs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1)"""
_METRICS = """cell AS (SELECT l.label, count(*) FILTER (WHERE s.label = l.label AND predicted = l.label) AS tp, count(*) FILTER (WHERE s.label <> l.label AND predicted = l.label) AS fp, count(*) FILTER (WHERE s.label = l.label AND predicted <> l.label) AS fn FROM {0} JOIN spl s USING (doc_id) CROSS JOIN (SELECT unnest([0, 1]) AS label) l GROUP BY l.label),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cell),
mm AS (SELECT 'macro' AS average, avg(p) AS p, avg(r) AS r, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f FROM pr UNION ALL SELECT 'micro', sum(tp) / sum(tp + fp), sum(tp) / sum(tp + fn), 2 * sum(tp) / sum(2 * tp + fp + fn) FROM pr)
SELECT average, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f1, round((p + r) / 2, 6) AS bep FROM mm"""


def _labels(spark, sf_dir) -> DataFrame:
    return SA.split(V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")), "label", "doc_id")


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Vectors and split of the labelled documents, written once: everything below starts from them."""

    def make() -> tuple[DataFrame, DataFrame]:
        labels = materialise(_labels(spark, sf_dir))
        tokens = _bodies(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi")
        return materialise(C.train_df_vectors(tokens, labels.where("is_train"))), labels

    return V.stored(spark, sf_dir, "vectors", make)


@query("stratified_split", f"WITH {_SPLIT} SELECT doc_id, label, is_train FROM spl")
def stratified_split(spark, sf_dir) -> DataFrame:
    return _labels(spark, sf_dir)


@query("label_distribution", "SELECT CAST(quality AS INTEGER) AS label, count(*) AS n FROM labels GROUP BY quality")
def label_distribution(spark, sf_dir) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("train_vectors", f"WITH {_VEC} SELECT doc_id, term, round(w, 6) AS w FROM vec")
def train_vectors(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir)[0].withColumn("w", F.round("w", 6))


@query("nb_statistics", f"WITH {_NB} SELECT label, term, n FROM cnt")
def nb_statistics(spark, sf_dir) -> DataFrame:
    return C.nb_statistics(*_vectors(spark, sf_dir))[0]


@query("nb_totals", f"WITH {_NB} SELECT label, docs, total FROM tot")
def nb_totals(spark, sf_dir) -> DataFrame:
    return C.nb_statistics(*_vectors(spark, sf_dir))[1]


def _nb(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vectors, labels = _vectors(spark, sf_dir)
    test = vectors.join(labels.where("not is_train").select("doc_id"), "doc_id", "left_semi")
    return C.nb_scores(test, *C.nb_statistics(vectors, labels)), labels


@query("nb_scores", f"WITH {_NB} SELECT doc_id, label, round(score, 6) AS score FROM nbs")
def nb_scores(spark, sf_dir) -> DataFrame:
    return _nb(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@query("nb_predict", f"WITH {_NB} SELECT doc_id, predicted FROM nbp")
def nb_predict(spark, sf_dir) -> DataFrame:
    return C.nb_predict(_nb(spark, sf_dir)[0])


@query("nb_confidence", f"WITH {_NB}, e AS (SELECT doc_id, label, score, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM nbs) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS INTEGER) AS rank, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS confidence FROM e")
def nb_confidence(spark, sf_dir) -> DataFrame:
    return C.probabilities(_nb(spark, sf_dir)[0])


@query("classification_metrics", f"WITH {_NB}, {_METRICS.format('nbp')}")
def classification_metrics(spark, sf_dir) -> DataFrame:
    scores, labels = _nb(spark, sf_dir)
    return C.metrics(C.confusion(C.nb_predict(scores), labels, 2))


_KNN = f"""{_VEC},
un AS (SELECT doc_id, term, w / CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY doc_id)) < 1e-9 THEN 1.0 ELSE sqrt(sum(w * w) OVER (PARTITION BY doc_id)) END AS u FROM vec),
dot AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.u * b.u) AS sim FROM un a JOIN spl sa ON a.doc_id = sa.doc_id AND NOT sa.is_train JOIN un b USING (term) JOIN spl sb ON b.doc_id = sb.doc_id AND sb.is_train GROUP BY ALL),
nb AS (SELECT t.doc_id, r.label, round(coalesce(sim, 0), 9) AS sim, row_number() OVER (PARTITION BY t.doc_id ORDER BY round(coalesce(sim, 0), 9) DESC, r.doc_id) AS rank FROM spl t JOIN spl r ON NOT t.is_train AND r.is_train LEFT JOIN dot ON i = t.doc_id AND j = r.doc_id QUALIFY rank <= 40),
vote AS (SELECT doc_id, label AS predicted FROM (SELECT doc_id, label, count(*) AS n, min(rank) AS f FROM nb WHERE rank <= 10 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)"""


def _neighbours(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vectors, labels = _vectors(spark, sf_dir)
    return C.knn_neighbours(vectors, labels), labels


@query("knn_neighbours", f"WITH {_KNN} SELECT doc_id, CAST(rank AS INTEGER) AS rank, label, round(sim, 6) AS sim FROM nb")
def knn_neighbours(spark, sf_dir) -> DataFrame:
    return _neighbours(spark, sf_dir)[0].withColumn("sim", F.round("sim", 6))


@query("knn_predict", f"WITH {_KNN} SELECT * FROM vote")
def knn_predict(spark, sf_dir) -> DataFrame:
    return C.knn_vote(_neighbours(spark, sf_dir)[0], 10)


@query("knn_metrics", f"WITH {_KNN}, {_METRICS.format('vote')}")
def knn_metrics(spark, sf_dir) -> DataFrame:
    neighbours, labels = _neighbours(spark, sf_dir)
    return C.metrics(C.confusion(C.knn_vote(neighbours, 10), labels, 2))


_ALL = _NB.replace(_SPLIT, f"{V.TOK},\nspl AS (SELECT doc_id, CAST(quality AS INTEGER) AS label, true AS is_train FROM labels)").replace("FROM tok SEMI JOIN spl USING (doc_id))", "FROM tok)").replace("FROM vec v JOIN spl s ON v.doc_id = s.doc_id AND NOT is_train CROSS JOIN tot t", "FROM vec v CROSS JOIN tot t").replace("FROM ctf JOIN spl", "FROM ctf JOIN spl")


def _model(spark, sf_dir) -> C.NbModel:
    """Trained on all labels, stored, and read back as a new session would."""

    def make() -> C.NbModel:
        labels = V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
        C.NbModel.fit(_bodies(spark, sf_dir), labels).save(path := f"{shared_dir(spark)}/model")
        return C.NbModel.load(spark, path)

    return V.stored(spark, sf_dir, "model", make)


def _bodies(spark, sf_dir) -> DataFrame:
    return V.token_rows(spark, sf_dir).select("doc_id", F.col("body_tokens").alias("tokens"))


@query("stored_model", f"WITH {_ALL} SELECT label, docs, total, (SELECT count(*) FROM cnt c WHERE c.label = tot.label) AS terms FROM tot")
def stored_model(spark, sf_dir) -> DataFrame:
    model = _model(spark, sf_dir)
    return model.totals.join(model.counts.groupBy("label").agg(F.count(F.lit(1)).alias("terms")), "label")


@query("corpus_predictions", f"WITH {_ALL}, e AS (SELECT doc_id, label, score, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM nbs) SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS confidence FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1")
def corpus_predictions(spark, sf_dir) -> DataFrame:
    """The stored model's label of every document that has tokens."""
    return _model(spark, sf_dir).predict(_bodies(spark, sf_dir)).select("doc_id", "label", "confidence")


_GRID = " UNION ALL ".join(
    [f"SELECT 'knn {k}' AS model, g.* FROM (WITH {_KNN.replace('rank <= 10', f'rank <= {k}')}, {_METRICS.format('vote')}) g" for k in C.KS]
    + [f"SELECT 'nb {a}' AS model, g.* FROM (WITH {_NB.replace('+ 0.1', f'+ {a}')}, {_METRICS.format('nbp')}) g" for a in C.ALPHAS]
)


@query("model_grid", _GRID)
def model_grid(spark, sf_dir) -> DataFrame:
    """Metrics of every k and every alpha."""
    vectors, labels = _vectors(spark, sf_dir)
    knn = C.knn_grid(materialise(C.knn_neighbours(vectors, labels)), labels, 2).select(F.concat(F.lit("knn "), F.col("k").cast("string")).alias("model"), "average", "p", "r", "f1", "bep")
    nb = C.nb_grid(vectors, labels, 2).select(F.concat(F.lit("nb "), F.col("alpha").cast("string")).alias("model"), "average", "p", "r", "f1", "bep")
    return knn.unionByName(nb)

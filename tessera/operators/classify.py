"""KNN and naive Bayes over TF-IDF vectors, and their metrics. Vectors are long tables doc_id, term, w."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import index as IX
from tessera.session import materialise

KS = (3, 5, 10, 15, 20, 25, 30, 35, 40)
ALPHAS = (0.01, 0.1, 0.5, 1.0, 2.0, 5.0)


def train_df_vectors(tokens: DataFrame, train: DataFrame, field: str = "tokens", k: int = 200) -> DataFrame:
    """doc_id, term, w of all documents with document frequencies of the training rows alone; a term they lack has df 0, so idf ln N."""
    return vectors_by(IX.term_counts(tokens, {field: 1.0}), *training_df(tokens, train, field), k)


def training_df(tokens: DataFrame, train: DataFrame, field: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(term, df) of the training rows, and their number as one row, n."""
    df = IX.document_frequency(IX.distinct_terms(tokens.join(train.select("doc_id"), "doc_id", "left_semi"), [field]))
    return df, train.agg(F.count(F.lit(1)).alias("n"))


def vectors_by(tf: DataFrame, df: DataFrame, n: DataFrame, k: int = 200) -> DataFrame:
    """doc_id, term, w: tf times smooth idf by given document frequencies, the k best of each document."""
    rows = tf.join(df, "term", "left").crossJoin(F.broadcast(n))  # one row
    scored = rows.select("doc_id", "term", (F.col("tf") * F.log(F.col("n") / (F.coalesce("df", F.lit(0)) + 1))).alias("w"))
    return IX.top_features(scored, k).select("doc_id", "term", "w")


def knn_neighbours(vectors: DataFrame, labels: DataFrame, k: int = max(KS), digits: int = 9) -> DataFrame:
    """doc_id, rank, label, sim of the k nearest training rows of each test row. labels: doc_id, label, is_train.

    Rows that share no term have similarity 0 and stand after those that do, by id. To find them
    a list of the k least ids is enough, so no cross product is built.
    """
    from tessera.operators.search import best_products

    unit = vectors.join(IX.norms(vectors), "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("u"))
    sides = unit.join(labels.select("doc_id", "is_train"), "doc_id").select("doc_id", "term", "u", F.col("is_train").cast("int").alias("side"))
    near = materialise(best_products(sides, k, digits)).select("i", "j", F.round("score", digits).alias("sim"))  # read twice below
    sims = near.join(labels.select(F.col("doc_id").alias("j"), "label"), "j").select("i", "j", "label", "sim")
    spare = labels.where("is_train").orderBy("doc_id").limit(k).select(F.col("doc_id").alias("j"), "label", F.lit(0.0).alias("sim"))
    every = labels.where("not is_train").select(F.col("doc_id").alias("i")).crossJoin(F.broadcast(spare))  # k rows
    both = sims.unionByName(every.join(sims.select("i", "j"), ["i", "j"], "left_anti"))
    rank = F.row_number().over(W.partitionBy("i").orderBy(F.desc("sim"), "j"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("i").alias("doc_id"), "rank", "label", "sim")


def knn_votes(neighbours: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, doc_id, predicted: for each k the commonest label of the k nearest, ties to the one met first."""
    each = F.filter(F.array(*map(F.lit, sorted(ks))), lambda k: k >= F.col("rank"))
    votes = neighbours.withColumn("k", F.explode(each)).groupBy("k", "doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return votes.groupBy("k", "doc_id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("predicted"))


def knn_vote(neighbours: DataFrame, k: int) -> DataFrame:
    """doc_id, predicted."""
    return knn_votes(neighbours, (k,)).select("doc_id", "predicted")


def nb_statistics(vectors: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, term, n) presence counts and (label, docs, total) sums of the training rows."""
    rows = vectors.join(labels.where("is_train").select("doc_id", "label"), "doc_id")
    counts = rows.groupBy("label", "term").agg(F.count_distinct("doc_id").alias("n"))
    totals = labels.where("is_train").groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    sums = counts.groupBy("label").agg(F.sum("n").alias("total"))
    return counts, totals.join(sums, "label", "left").select("label", "docs", F.coalesce("total", F.lit(0)).alias("total"))


def nb_scores_by(vectors: DataFrame, counts: DataFrame, totals: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """alpha, doc_id, label, score (log): prior plus likelihoods of the distinct terms; a term no class has counts ln(1/|V|) in all.

    Every class starts from the sum it would have if none of the terms were seen in it;
    seen terms add their difference. So only (term, class) pairs that exist are joined, once for all alphas.
    """
    known = counts.groupBy("term").agg(F.collect_list(F.struct("label", "n")).alias("seen"))  # a row per term, of at most as many entries as classes
    size = known.agg(F.count(F.lit(1)).alias("size"))
    n_docs = totals.agg(F.sum("docs").alias("n_docs"))
    own = vectors.select("doc_id", "term").distinct().join(known, "term", "left")
    base = totals.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(n_docs))  # one row each
    base = base.select("label", "total", "size", F.log(F.col("docs") / F.col("n_docs")).alias("prior"), F.log(F.greatest("size", F.lit(1))).alias("ln_size"))
    # One pass over the terms: an entry per class that has the term, and one without class that says whether any has it.
    entry = F.struct(F.lit(True).alias("mark"), F.lit(None).cast(counts.schema["label"].dataType).alias("label"), F.lit(None).cast(counts.schema["n"].dataType).alias("n"))
    seen = F.transform(F.coalesce("seen", F.array().cast(known.schema["seen"].dataType)), lambda x: F.struct(F.lit(False).alias("mark"), x["label"].alias("label"), x["n"].alias("n")))
    rows = own.select("doc_id", F.col("seen").isNull().alias("unknown"), F.explode(F.concat(F.array(entry), seen)).alias("x")).select("doc_id", "unknown", "x.*")
    gains = [F.sum(F.log((F.col("n") + a) / a)).alias(f"gain_{i}") for i, a in enumerate(alphas)]
    per_class = rows.groupBy("doc_id", "mark", "label").agg(F.count_if(~F.col("unknown")).alias("n_known"), F.count_if("unknown").alias("n_unknown"), *gains)
    ofs = F.collect_list(F.when(~F.col("mark"), F.struct("label", *(f"gain_{i}" for i in range(len(alphas)))))).alias("classes")
    terms = per_class.groupBy("doc_id").agg(F.max(F.when(F.col("mark"), F.col("n_known"))).alias("n_known"), F.max(F.when(F.col("mark"), F.col("n_unknown"))).alias("n_unknown"), ofs)
    every = terms.crossJoin(F.broadcast(base)).withColumn("own", F.filter("classes", lambda x: x["label"] == F.col("label")))  # a row per class
    every = every.select("doc_id", "label", "total", "size", "prior", "ln_size", "n_known", "n_unknown", *(F.get("own", F.lit(0))[f"gain_{i}"].alias(f"gain_{i}") for i in range(len(alphas))))

    def score(i: int, a: float):
        unseen = F.log(F.lit(a) / (F.col("total") + a * F.col("size")))
        return F.col("prior") + F.col("n_known") * unseen - F.col("n_unknown") * F.col("ln_size") + F.coalesce(f"gain_{i}", F.lit(0.0))

    each = F.array(*(F.struct(F.lit(a).alias("alpha"), F.round(score(i, a), 9).alias("score")) for i, a in enumerate(alphas)))
    return every.select("doc_id", "label", F.explode(each).alias("x")).select("x.alpha", "doc_id", "label", "x.score")


def nb_scores(vectors: DataFrame, counts: DataFrame, totals: DataFrame, alpha: float = 0.1) -> DataFrame:
    """doc_id, label, score."""
    return nb_scores_by(vectors, counts, totals, (alpha,)).drop("alpha")


def nb_predict(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by, "doc_id").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("predicted"))


def probabilities(scores: DataFrame, top: int = 3) -> DataFrame:
    """doc_id, rank, label, confidence: softmax over the classes, shifted by the greatest score."""
    w = W.partitionBy("doc_id")
    e = F.exp(F.col("score") - F.max("score").over(w))
    out = scores.withColumn("e", e).withColumn("confidence", F.round(F.col("e") / F.sum("e").over(w), 6))
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "label"))).where(F.col("rank") <= top).select("doc_id", "rank", "label", "confidence")


def predict_text(spark, text: str, tokens: list[str], train_df: DataFrame, n_train: int, counts: DataFrame, totals: DataFrame, names: dict[int, str], alpha: float = 0.1, k: int = 200) -> dict:
    """label, label_id, confidence and the three best labels of one text."""
    if not text.strip() or not tokens:
        return {"label": "未知", "label_id": -1, "confidence": 0.0, "top3": []}
    rows = spark.createDataFrame([(0, t) for t in tokens], "doc_id long, term string").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    scored = rows.join(train_df, "term", "left").select("doc_id", "term", (F.col("tf") * F.log(F.lit(n_train) / (F.coalesce("df", F.lit(0)) + 1))).alias("w"))
    best = probabilities(nb_scores(IX.top_features(scored, k).select("doc_id", "term", "w"), counts, totals, alpha)).orderBy("rank").collect()
    top = [(names.get(r.label, str(r.label)), r.confidence) for r in best]
    return {"label": top[0][0], "label_id": best[0].label, "confidence": top[0][1], "top3": top}


def confusion(predicted: DataFrame, labels: DataFrame, n_classes: int, by: str | None = None, values: tuple = ()) -> DataFrame:
    """label, tp, fp, fn of every class, and for each of the values of a grid if asked for. predicted: doc_id, predicted; labels: doc_id, label."""
    own = [by] if by else []
    rows = labels.select("doc_id", "label").join(predicted, "doc_id")
    right, wrong, no = F.col("label") == F.col("predicted"), F.col("label") != F.col("predicted"), F.lit(False)
    sides = F.array(F.struct(F.col("label").alias("c"), right.alias("tp"), no.alias("fp"), wrong.alias("fn")), F.struct(F.col("predicted").alias("c"), no.alias("tp"), wrong.alias("fp"), no.alias("fn")))
    counts = rows.select(*own, F.explode(sides).alias("s")).select(*own, "s.*").groupBy(*own, "c").agg(*(F.count_if(x).alias(x) for x in ("tp", "fp", "fn")))
    classes = predicted.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("c"))
    if by:
        classes = classes.withColumn(by, F.explode(F.array(*map(F.lit, values))))
    return classes.join(counts, [*own, "c"], "left").select(*own, F.col("c").alias("label"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("tp", "fp", "fn")))


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def metrics(cells: DataFrame, *by: str) -> DataFrame:
    """macro and micro P, R, F1 and break-even point of per-class cells, for each value of by."""
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("fp")), ratio(F.col("tp"), F.col("fn"))
    s = lambda c: F.sum(c)
    mp, mr = ratio(s("tp"), s("fp")), ratio(s("tp"), s("fn"))
    macro = cells.groupBy(*by).agg(F.avg(p).alias("p"), F.avg(r).alias("r"), F.avg(_f1(p, r)).alias("f1"), mp.alias("mp"), mr.alias("mr"))
    rows = F.array(
        F.struct(F.lit("macro").alias("average"), F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round("f1", 6).alias("f1"), F.round((F.col("p") + F.col("r")) / 2, 6).alias("bep")),
        F.struct(F.lit("micro").alias("average"), F.round("mp", 6).alias("p"), F.round("mr", 6).alias("r"), F.round(_f1(F.col("mp"), F.col("mr")), 6).alias("f1"), F.round((F.col("mp") + F.col("mr")) / 2, 6).alias("bep")),
    )
    return macro.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def knn_grid(neighbours: DataFrame, labels: DataFrame, n_classes: int, ks: tuple[int, ...] = KS) -> DataFrame:
    """k and its metrics, from one pass over one neighbour table."""
    return metrics(confusion(knn_votes(neighbours, ks), labels, n_classes, "k", ks), "k")


def nb_grid(vectors: DataFrame, labels: DataFrame, n_classes: int, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """alpha and its metrics, from one pass over the (term, class) counts."""
    counts, totals = nb_statistics(vectors, labels)
    test = vectors.join(labels.where("not is_train").select("doc_id"), "doc_id", "left_semi")
    return metrics(confusion(nb_predict(nb_scores_by(test, counts, totals, alphas), "alpha"), labels, n_classes, "alpha", alphas), "alpha")


@dataclass
class NbModel:
    """A trained naive Bayes model as tables: term counts per class, class totals, document frequencies, number of training rows."""

    counts: DataFrame  # label, term, n
    totals: DataFrame  # label, docs, total
    df: DataFrame  # term, df
    n: DataFrame  # n
    alpha: float = 0.1

    @staticmethod
    def fit(tokens: DataFrame, labels: DataFrame, field: str = "tokens", alpha: float = 0.1, k: int = 200) -> NbModel:
        """Trained on all labelled documents (labels: doc_id, label)."""
        train = labels.where("label is not null").select("doc_id", "label", F.lit(True).alias("is_train"))
        own = tokens.join(train.select("doc_id"), "doc_id", "left_semi")
        df, n = training_df(tokens, train, field)
        vectors = materialise(vectors_by(IX.term_counts(own, {field: 1.0}), df, n, k))
        return NbModel(*nb_statistics(vectors, train), df, n, alpha)

    def save(self, path: str) -> NbModel:
        """Writes the tables below path and returns the model that reads them."""
        spark = self.counts.sparkSession
        for name in _TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(self.alpha,)], "alpha double").write.mode("overwrite").parquet(f"{path}/parameters")
        return NbModel.load(spark, path)

    @staticmethod
    def load(spark, path: str) -> NbModel:
        tables = [spark.read.parquet(f"{path}/{name}") for name in _TABLES]
        return NbModel(*tables, spark.read.parquet(f"{path}/parameters").first()["alpha"])

    def scores(self, tokens: DataFrame, field: str = "tokens", k: int = 200) -> DataFrame:
        """doc_id, label, score of all documents that have tokens, with the document frequencies of training."""
        return nb_scores(vectors_by(IX.term_counts(tokens, {field: 1.0}), self.df, self.n, k), self.counts, self.totals, self.alpha)

    def predict(self, tokens: DataFrame, field: str = "tokens", top: int = 1) -> DataFrame:
        """doc_id, rank, label, confidence of the best labels."""
        return probabilities(self.scores(tokens, field), top)


_TABLES = ("counts", "totals", "df", "n")


#: A category dictionary has these columns: name, definition, merged_from, keywords.
CATEGORY_SCHEMA = "label int, name string, definition string, merged_from string, keywords array<string>"


def categories(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CATEGORY_SCHEMA)

"""The page and API queries, over one index. Each returns DataFrames; rendering is up to the caller."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import present
from tessera.functions.dates import iso
from tessera.operators import cluster, keywords, profile, search
from tessera.operators.filters import Filters
from tessera.plans import query_parser as Q

SALARY_BINS = [0.01, 5000, 8000, 10000, 15000, 20000, 30000, 50000]


@dataclass
class Result:
    """A page of hits with what the caller shows around it."""

    rows: DataFrame
    total: int
    page: int
    total_pages: int
    terms: list[str]
    hints: list[str]
    parsed: dict


@dataclass
class Service:
    index: search.Index
    vocabulary: Q.Vocabulary = field(default_factory=Q.Vocabulary)
    words: set[str] = field(default_factory=set)
    stop: set[str] = field(default_factory=set)
    lists: DataFrame | None = None
    similar: DataFrame | None = None

    def request(self, text: str, filters: Filters | None = None, sort_by: str = "relevance", page: int = 1, page_size: int = search.PAGE) -> tuple[search.Request, Q.Parsed]:
        parsed = Q.parse(text, self.vocabulary)
        conditions = parsed.parsed | {"experience": Q.experience_filter(parsed.parsed["experience"])}
        merged = (filters or Filters()).merged(conditions)
        terms = Q.query_terms(text, merged.active(), self.words, self.stop)
        return search.Request(terms, text.strip(), merged, sort_by, page, page_size), parsed

    def search(self, text: str, filters: Filters | None = None, sort_by: str = "relevance", page: int = 1, page_size: int = search.PAGE) -> Result:
        r, parsed = self.request(text, filters, sort_by, page, page_size)
        hits = search.scored(self.index, r).persist()
        try:
            total = hits.count()
            shown = cards(search.page(hits, r), r.terms)
            rows = self.index.docs.sparkSession.createDataFrame(shown.collect(), shown.schema)  # a page
        finally:
            hits.unpersist()
        return Result(rows, total, page, search.page_count(total, page_size), r.terms, parsed.hints, parsed.parsed)

    def home(self) -> dict[str, DataFrame]:
        docs = self.index.docs
        return {"industries": profile.value_counts(docs, "industry", 9), "latest": latest(docs), "cities": profile.value_counts(docs, "city", 20)}

    def record(self, doc_id: int) -> dict[str, DataFrame] | None:
        view = search.record_view(self.index.docs, self.lists)
        own = view.where(F.col("doc_id") == doc_id)
        if not own.take(1):
            return None
        out = {"record": own.withColumn("keywords", F.slice("keywords", 1, 10))}
        if self.similar is not None:
            out["similar"] = search.similar_records(self.similar, view, doc_id)
        return out

    def industries(self, top: int = 9) -> DataFrame:
        counts = profile.value_counts(self.index.docs, "industry", top)
        if self.lists is None:
            return counts
        best = keywords.by_dimension(self.lists, self.index.docs, "industry", 5)
        words = best.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("r")).select("value", F.col("r.term").alias("keywords"))
        return counts.join(words, "value", "left").orderBy(F.desc("n"), "value")

    def statistics(self) -> dict[str, DataFrame]:
        docs = self.index.docs
        paid = docs.where("salary_min > 0 and salary_max > 0")
        return {
            "categories": search.field_counts(docs, {"industry": 9, "city": 10, "education": None, "experience": None}),
            "salaries": profile.histogram(paid, (F.col("salary_min") + F.col("salary_max")) / 2, SALARY_BINS),
        }

    def counts(self) -> DataFrame:
        return self.index.docs.agg(F.count(F.lit(1)).alias("jobs"), F.count_distinct("industry").alias("industries"), F.count_distinct("city").alias("cities"), F.count_distinct("company").alias("companies"))

    def cities(self, top: int = 30) -> DataFrame:
        return profile.value_counts(self.index.docs, "city", top)

    def map_data(self, gazetteer: DataFrame) -> DataFrame:
        """city, n, lng, lat, symbol_size of the cities that the gazetteer (city, lng, lat) knows."""
        counts = profile.value_counts(self.index.docs, "city").withColumnRenamed("value", "city")
        return profile.symbol_sizes(counts.join(gazetteer, "city"))

    def clusters(self, labels: DataFrame) -> DataFrame:
        return cluster.names(labels)

    def facets(self) -> DataFrame:
        return search.facets(self.index.docs)


def latest(docs: DataFrame, n: int = 8) -> DataFrame:
    top = docs.orderBy(F.desc_nulls_last("pub_date"), "doc_id").limit(n)
    return top.select("doc_id", "title", "company", "city", present.salary_text(F.col("salary_min"), F.col("salary_max")).alias("salary"), iso(F.col("pub_date")).alias("pub_date"))


def cards(hits: DataFrame, terms: list[str], most: int = 150) -> DataFrame:
    """Search results as clients show them, with marked snippets."""
    return hits.select(
        "rank", "doc_id", "score", present.highlight(F.col("title"), terms).alias("title"), "company", "industry", "city", "education", "experience", present.salary_text(F.col("salary_min"), F.col("salary_max")).alias("salary"), iso(F.col("pub_date")).alias("pub_date"), present.snippet(F.col("body"), terms, most).alias("snippet")
    ).orderBy("rank")


def annotation_hits(service: Service, specs: list[dict], top: int = 10) -> DataFrame:
    """Hits of all query specs (query_id, q, filters) for judging, with a preview of 200 characters."""
    out = None
    for s in specs:
        r, _ = service.request(s["q"], Filters(**s.get("filters", {})), page_size=top)
        rows = search.search(service.index, r).select(F.lit(s["query_id"]).alias("query_id"), "rank", "doc_id", "score", "title", F.substring("body", 1, 200).alias("preview"))
        out = rows if out is None else out.unionByName(rows)
    return out

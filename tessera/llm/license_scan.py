"""Licence scan by canonical digest lookup, with DataFrame functions only.

A text is canonical with A-Z in lower case, copyright lines gone, everything between
words (ASCII punctuation and white space, typographic quotes and dashes) as one space, and
equivalent spellings made one. Its SHA-256 is looked up among the digests of the known licences,
which are a constant of the program (about a hundred rows) and so are broadcast. The
same digest, taken of the single lines that could be notices, finds notices
inside other texts.

Nothing is shuffled. Defined results: null text has no digest and no licence; a text that
is empty when canonical has the digest of the empty text, which is no licence; repeated
rows are scanned alike; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower
from tessera.llm.license_digests import DIGESTS
from tessera.llm.license_texts import NOTICES, TEXTS

#: Whole lines that only say whose the copyright is.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t:,]*(\(c\)|©|[0-9]{4}|\[year|<year)|(\(c\)|©)[ \t]*(copyright[ \t]*)?[0-9]|all rights reserved)[^\n]*$"
#: Bytes that only separate words, and the typographic forms of quotes, dashes and spaces.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F ©‐-―‘-‟…  　]+"
#: Equivalent spellings; the right one stands for both.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("centre", "center"),
    ("analyse", "analyze"),
    ("recognise", "recognize"),
    ("initialise", "initialize"),
    ("modelling", "modeling"),
    ("practise", "practice"),
    ("programme", "program"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("noncommercial", "non commercial"),
    ("https", "http"),
]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "")
    # Two spaces between words: each word keeps its own when its neighbour is replaced.
    out = F.concat(F.lit("  "), F.regexp_replace(out, BETWEEN, "  "), F.lit("  "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.replace(F.replace(out, F.lit("    "), F.lit(" ")), F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark, entries: list[tuple[str, str]]) -> DataFrame:
    """known_digest, license of the known entries, one row a digest."""
    rows = spark.createDataFrame(entries, "license string, entry string")
    return rows.select(digest(F.col("entry")).alias("known_digest"), "license").groupBy("known_digest").agg(F.min("license").alias("license"))


def could_be_notice(line: Column) -> Column:
    """Whether a line, of whatever length, has a word that all notices have."""
    low = ascii_lower(line)
    return low.contains("licen") | low.contains("copyright")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license (of the whole text, or null), notices (sorted identifiers, comma-joined) of every document."""
    spark = documents.sparkSession
    long = spark.createDataFrame(DIGESTS, "license string, known_digest string").select("known_digest", "license")
    whole = known(spark, TEXTS).unionByName(long)
    notices = known(spark, NOTICES).orderBy("known_digest").collect()  # the program's own constant
    of_notice = F.create_map(*(x for r in notices for x in (F.lit(r.known_digest), F.lit(r.license))))
    lines = F.filter(F.split("text", "\n"), could_be_notice)
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, lambda line: F.element_at(of_notice, digest(line))))))
    rows = documents.select("doc_id", digest(F.col("text")).alias("canonical_sha256"), F.coalesce(F.array_join(found, ","), F.lit("")).alias("notices"))
    return rows.join(F.broadcast(whole), F.col("canonical_sha256") == F.col("known_digest"), "left").select("doc_id", "canonical_sha256", "license", "notices")


def _sql(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    between = "".join(f"\\x{{{x[2:]}}}" if x.startswith("\\u") else x for x in _split_escapes(BETWEEN))
    out = f"regexp_replace({low}, '{COPYRIGHT_LINE}', '', 'g')"
    out = f"'  ' || regexp_replace({out}, '{between}', '  ', 'g') || '  '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"sha256(trim(replace(replace({out}, '    ', ' '), '  ', ' '), ' '))"


def _split_escapes(pattern: str) -> list[str]:
    out, i = [], 0
    while i < len(pattern):
        n = 6 if pattern.startswith("\\u", i) else 1
        out.append(pattern[i : i + n])
        i += n
    return out


def _values(entries: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in entries)


def oracle() -> str:
    """The same scan in SQL."""
    line = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH texts AS (SELECT {_sql('t')} AS d, min(k) AS license FROM (VALUES {_values(TEXTS)}) v(k, t) GROUP BY 1),
notices AS (SELECT {_sql('t')} AS d, min(k) AS license FROM (VALUES {_values(NOTICES)}) v(k, t) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
candidates AS (SELECT r, {_sql('line')} AS d FROM lines WHERE contains({line}, 'licen') OR contains({line}, 'copyright')),
whole AS (SELECT * FROM texts UNION ALL SELECT * FROM (VALUES {', '.join(f"('{d}', '{k}')" for k, d in DIGESTS)})),
found AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM candidates JOIN notices USING (d) GROUP BY r),
digests AS (SELECT r, doc_id, {_sql('text')} AS canonical_sha256 FROM docs)
SELECT doc_id, canonical_sha256, license, coalesce(notices, '') AS notices
FROM digests LEFT JOIN whole ON canonical_sha256 = d LEFT JOIN found USING (r)"""

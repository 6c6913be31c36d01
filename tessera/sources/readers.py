"""Scans: delimited, text, JSON and annotation files. All paths go through Spark, only the encoding probe reads bytes itself."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import decode_tokens, parse_number

ENCODINGS = ("gbk", "gb2312", "gb18030", "utf-8", "utf-16")


def detect_encoding(sample: bytes, encodings: tuple[str, ...] = ENCODINGS, default: str = "utf-8") -> str:
    """First encoding that decodes the sample, which may end inside a character."""
    if sample.startswith(codecs.BOM_UTF8):
        return "utf-8"
    for name in encodings:
        try:
            codecs.getincrementaldecoder(name)().decode(sample)
        except (UnicodeDecodeError, UnicodeError):
            continue
        return name
    return default


def head_bytes(spark: SparkSession, path: str, n: int = 100_000) -> bytes:
    """First bytes of a file, read through Hadoop; a missing file raises FileNotFoundError."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, fs.getFileStatus(p).getLen())))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str | None = None) -> DataFrame:
    """Quoted CSV with line breaks inside fields; without a schema all columns are strings."""
    encoding = encoding or detect_encoding(head_bytes(spark, path))
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿"))


def read_raw(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("gbk", "gb18030", "utf-8", "utf-16"), probe: int = 50_000, numbers: tuple[str, ...] = ("salary_min", "salary_max")) -> DataFrame:
    """CSV by the first encoding that decodes a probe of the file; the columns named as numbers are doubles, null where they are none."""
    df = read_csv(spark, path, encoding=detect_encoding(head_bytes(spark, path, probe), encodings))
    return df.withColumns({c: parse_number(F.col(c)) for c in numbers if c in df.columns})


def read_segmented(spark: SparkSession, path: str, columns: dict[str, str] | None = None, sep: str = "/") -> DataFrame:
    """Segmented CSV with token arrays: the named columns (column -> name of its tokens), or the last two as body_tokens and title_tokens."""
    df = read_csv(spark, path)
    own = columns or dict(zip(df.columns[-2:], ("body_tokens", "title_tokens"), strict=False))
    return df.select(*(c for c in df.columns if c not in own), *(decode_tokens(F.col(c), sep).alias(name) for c, name in own.items()))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """The category dictionary of a JSON list of name, definition, merged_from, keywords; labels are places in the list."""
    with_place = spark.read.option("multiLine", True).option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", "array<struct<name:string,definition:string,merged_from:string,keywords:array<string>>>")).alias("label", "c"))
    return with_place.select("label", "c.*")


def preview(df: DataFrame, key: str, fields: list[str], n: int = 3) -> DataFrame:
    """Some fields of the first rows by key."""
    return df.orderBy(key).limit(n).select(*fields)


def first_rows(df: DataFrame, key: str, n: int = 5000) -> DataFrame:
    return df.orderBy(key).limit(n)


def lines(df: DataFrame, column: str = "value", comments: bool = True) -> DataFrame:
    """Trimmed non-blank lines; comment lines (#) go unless comments is false."""
    out = df.select(F.trim(column).alias("line")).where("line <> ''")
    return out.where(~F.col("line").startswith("#")) if comments else out


def read_lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    return lines(spark.read.text(path), comments=comments)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON document, or an empty frame of the schema if the file is absent."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet artefact, or an empty frame of the schema if it is absent."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def annotation_blocks(text: Column, opening: str) -> Column:
    """Annotation text cut before each block's opening, so that an unlabelled block can't take the next one's label."""
    return F.filter(F.split(text, rf"(?m)(?=^{opening})"), lambda b: b.rlike(rf"^{opening}"))


def parse_labels(df: DataFrame, column: str = "value") -> DataFrame:
    """sample_no, label of blocks ``### 样本 n ... 【标注】: k``."""
    block = df.select(F.explode(annotation_blocks(F.col(column), r"### 样本\s*[0-9]+")).alias("b"))
    return block.select(F.regexp_extract("b", r"^### 样本\s*([0-9]+)", 1).cast("int").alias("sample_no"), F.regexp_extract("b", r"【标注】\s*[:：]\s*([0-9]+)", 1).try_cast("int").alias("label")).where("label is not null")


def parse_gold(df: DataFrame, column: str = "value") -> DataFrame:
    """doc_id, gold of blocks ``### 文档 n (原始ID: k) ... 金标准关键词: a,b``."""
    block = df.select(F.explode(annotation_blocks(F.col(column), r"### 文档")).alias("b"))
    words = F.split(F.regexp_extract("b", r"金标准关键词\s*[:：]([^\n]*)", 1), "[,，、]")
    return block.select(F.regexp_extract("b", r"原始ID\s*[:：]\s*([0-9]+)", 1).try_cast("bigint").alias("doc_id"), F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "").alias("gold")).where("doc_id is not null")

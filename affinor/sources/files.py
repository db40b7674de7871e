"""File sources and sinks: JSON arrays, JSON lines, CSV, keyed vectors, cached response trees, nested API records."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from affinor.functions.text import abstract_from_positions, short_id
from affinor.session import scratch_path


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One file = one array (or object) of records. Such a file cannot be split, so large tables should land as lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One record per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> int:
    """Write and return the number of rows, counted by the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").option("dateFormat", "yyyy-MM-dd").json(path)
    return seen.get["rows"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV in UTF-8; a byte-order mark before the first column name is dropped."""
    df = spark.read.option("header", True).option("multiLine", False).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order, other columns left out, null as empty."""
    df.select(*columns).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_vectors(df: DataFrame, path: str, key: str, v: str = "v") -> None:
    df.select(F.col(key).cast("string").alias("key"), F.col(v).cast("array<float>").alias("v")).write.mode("errorifexists").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, v array<float>").parquet(path)


def read_response_tree(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Every JSON file below a folder with its path; malformed records are dropped."""
    return (spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)
            .withColumn("file", F.input_file_name()))


def latest_by_file(rows: DataFrame, key: str, value: str, file: str = "file") -> DataFrame:
    """The value of the last file (in name order) that has the key."""
    return rows.groupBy(key).agg(F.max_by(value, file).alias(value))


def works_table(raw: DataFrame) -> DataFrame:
    """Landed works: ids shortened, abstract rebuilt from its positions, first five topics typed with a missing score as 0."""
    topic = lambda t: F.struct(short_id(t["id"]).alias("id"), t["display_name"].alias("name"),
                               F.coalesce(t["score"], F.lit(0.0)).alias("score"), t["subfield"]["display_name"].alias("subfield"),
                               t["field"]["display_name"].alias("field"), t["domain"]["display_name"].alias("domain"))
    return raw.select(
        short_id(F.col("id")).alias("item"), F.coalesce("display_name", F.lit("(untitled)")).alias("title"),
        F.col("publication_year").alias("year"), F.col("publication_date").alias("pub_raw"), "type", "doi",
        F.coalesce("cited_by_count", F.lit(0)).alias("cites"), abstract_from_positions(F.col("abstract_inverted_index")).alias("abstract"),
        F.transform(F.slice("topics", 1, 5), topic).alias("topics"), "authorships")


def profiles_table(raw: DataFrame, home: str, max_names: int = 20) -> DataFrame:
    """Landed author records with the fields the matcher reads: up to 20 other names, affiliations of the home institution."""
    return raw.select(
        short_id(F.col("id")).alias("candidate"), F.col("display_name").alias("name"),
        F.slice(F.coalesce("display_name_alternatives", F.array().cast("array<string>")), 1, max_names).alias("alternatives"),
        short_id(F.col("orcid")).alias("orcid"), F.coalesce("works_count", F.lit(0)).alias("works"),
        F.filter("affiliations", lambda a: short_id(a["institution"]["id"]) == home).alias("affiliations"),
        F.transform("last_known_institutions", lambda i: short_id(i["id"])).alias("last_known"), "topics")


def check_registry(departments: DataFrame, universities: DataFrame, fields: DataFrame) -> DataFrame:
    """(problem, code): duplicate department codes, and departments of an unknown university or field."""
    dup = departments.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate code").alias("problem"), "code")
    no_univ = departments.join(universities, "univ", "left_anti").select(F.lit("unknown university").alias("problem"), "code")
    no_field = departments.join(fields, "field", "left_anti").select(F.lit("unknown field").alias("problem"), "code")
    return dup.union(no_univ).union(no_field)

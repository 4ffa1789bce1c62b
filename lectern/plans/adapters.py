"""The benchmark tables seen as files, pages, memories, links and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.evals import flattened

AS_OF = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files with path, type, tags, checksum, status and times."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    mime = F.when(n % 5 == 0, "text/csv").when(n % 5 == 1, "text/markdown").otherwise("text/plain")
    name = F.concat(F.lit("doc_"), n.cast("string"), F.when(n % 5 == 0, ".csv").when(n % 5 == 1, ".md").otherwise(".txt"))
    created = F.timestamp_add("DAY", (n % 200).cast("int"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"))
    return d.select(
        n.alias("file_id"), name.alias("filename"), F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("source_path"), mime.alias("mime_type"),
        F.col("n_chars").alias("file_size"), F.array("lang", "source").alias("tags"), F.when(n % 50 == 7, "processing").when(n % 50 == 9, "failed").otherwise("ready").alias("status"),
        F.to_json(F.struct(F.col("source").alias("source"), F.col("lang").alias("lang"))).alias("metadata"), created.alias("created_at"), F.timestamp_add("HOUR", (n % 31).cast("int"), created).alias("updated_at"), "text",
    )


FILES_SQL = """files AS (SELECT doc_id AS file_id, 'doc_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.csv' WHEN doc_id % 5 = 1 THEN '.md' ELSE '.txt' END AS filename,
  'data/' || source || '/' || lang || '/doc_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.csv' WHEN doc_id % 5 = 1 THEN '.md' ELSE '.txt' END AS source_path,
  CASE WHEN doc_id % 5 = 0 THEN 'text/csv' WHEN doc_id % 5 = 1 THEN 'text/markdown' ELSE 'text/plain' END AS mime_type, n_chars AS file_size, [lang, source] AS tags,
  CASE WHEN doc_id % 50 = 7 THEN 'processing' WHEN doc_id % 50 = 9 THEN 'failed' ELSE 'ready' END AS status, source, lang,
  TIMESTAMP '2023-01-01' + to_days((doc_id % 200)::INT) AS created_at, TIMESTAMP '2023-01-01' + to_days((doc_id % 200)::INT) + to_hours(doc_id % 31) AS updated_at, text FROM documents)"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into pages of 10 lines."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    rows = d.select(F.col("doc_id").alias("file_id"), lines.alias("l"), F.posexplode(F.sequence(F.lit(1), F.size(lines), F.lit(10))).alias("p", "at"))
    mime = F.when(F.col("file_id") % 5 == 0, "text/csv").when(F.col("file_id") % 7 == 0, "presentation").otherwise("text/plain")
    title = F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("s"), (F.col("file_id") % 11).cast("string"), F.lit(" - rows "), F.col("at").cast("string")))
    return rows.select("file_id", (F.col("p") + 1).alias("page_number"), title.alias("section_title"), F.array_join(F.slice("l", F.col("at"), F.lit(10)), "\n").alias("text"), mime.alias("mime_type"))


PAGES_SQL = """lines_ AS (SELECT doc_id AS file_id, string_split(text, chr(10)) AS l FROM documents),
pages_ AS (SELECT file_id, (nth - 1) // 10 + 1 AS page_number, CASE WHEN file_id % 5 = 0 THEN 's' || (file_id % 11) || ' - rows ' || nth END AS section_title,
  array_to_string(l[nth : nth + 9], chr(10)) AS text, CASE WHEN file_id % 5 = 0 THEN 'text/csv' WHEN file_id % 7 = 0 THEN 'presentation' ELSE 'text/plain' END AS mime_type
  FROM (SELECT file_id, l, unnest(range(1, len(l) + 1, 10)) AS nth FROM lines_))"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as memories, one each."""
    n = F.col("memory_id")
    at = F.timestamp_add("DAY", (n % 90).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = flattened(table(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "memory_id")
    return rows.select(
        "memory_id", "content", F.element_at(F.array(F.lit("episodic"), F.lit("semantic"), F.lit("procedural")), (n % 3 + 1).cast("int")).alias("memory_type"), F.array(F.concat(F.lit("t"), (n % 4).cast("string"))).alias("tags"),
        F.when(n % 5 == 0, F.concat(F.lit('{"date":"2024-0'), (n % 4 + 1).cast("string"), F.lit('-15"}'))).otherwise("{}").alias("metadata"), (n % 37 == 0).alias("pinned"), F.lit("unknown").alias("source"),
        (1 - (n % 10) * 0.05).alias("confidence"), (n % 4).alias("access_count"), at.alias("created_at"), F.timestamp_add("DAY", (n % 7).cast("int"), at).alias("updated_at"),
        F.when(n % 2 == 1, F.timestamp_add("DAY", F.lit(10), at)).alias("last_accessed"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(None).cast("bigint").alias("superseded_id"),
    )


MEMORIES_SQL = """memories AS (SELECT conv_id AS memory_id, content, ['episodic', 'semantic', 'procedural'][conv_id % 3 + 1] AS memory_type, ['t' || (conv_id % 4)] AS tags,
  conv_id % 37 = 0 AS pinned, 1 - (conv_id % 10) * 0.05::DOUBLE AS confidence, conv_id % 4 AS access_count, TIMESTAMP '2024-01-01' + to_days((conv_id % 90)::INT) AS created_at,
  TIMESTAMP '2024-01-01' + to_days((conv_id % 90 + conv_id % 7)::INT) AS updated_at, CASE WHEN conv_id % 2 = 1 THEN TIMESTAMP '2024-01-01' + to_days((conv_id % 90 + 10)::INT) END AS last_accessed,
  CASE WHEN conv_id % 5 = 0 THEN make_timestamp(2024, conv_id % 4 + 1, 15, 0, 0, 0) END AS dated
  FROM (SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id))"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_page, host, target): href attributes of pages."""
    from lectern.operators.links import html_links

    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("from_page"), F.explode(html_links(F.col("html"))).alias("target"))
    return rows

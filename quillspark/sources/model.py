"""The given tables read as the community model.

Every relation is a projection of one table, so filters and column pruning reach the
Parquet scan. ``MODEL_SQL`` states the same projections in SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream source, be it one file or a folder of part files.

    A stream refuses a path that names a file, but takes a pattern that matches one or a folder.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when their scan has too few parts to use them.

    Text work costs far more than moving the text once. Scans of at least as many parts as
    cores, which every large table has, are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# Behaviour events ------------------------------------------------------------------

def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as behaviour facts; the note is the number in ``props``, 0 means none."""
    note = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("source_event_id"),
        (F.lit(1) + note % 3).alias("project_id"),
        "user_id",
        F.nullif(note, F.lit(0)).alias("note_id"),
        F.expr(
            "CASE event_type WHEN 'view' THEN 'note_viewed' WHEN 'click' THEN 'media_viewed' "
            "WHEN 'purchase' THEN 'note_collected' WHEN 'signup' THEN 'note_created' "
            "WHEN 'error' THEN 'comment_created' ELSE event_type END"
        ).alias("event_type"),
        F.col("ts").alias("occurred_at"),
        F.concat_ws("-", F.lit("s"), F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
        .alias("session_id"),
        "event_id",
        "value",
    )


def note_like_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes of comments: comment-creating events point at one turn of conversation ``k``."""
    note = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        (note * 1000 + F.col("user_id") % 8 + 1).alias("comment_id"), "user_id"
    )


# Notes, interactions and comments ----------------------------------------------------

def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as notes with stored counters that may have drifted."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("id"),
        (F.lit(1) + F.col("o_custkey") % 5).alias("project_id"),
        F.col("o_custkey").alias("author_id"),
        F.concat_ws(" ", F.lit("Note"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("title"),
        F.concat_ws(" ", F.lit("Order of customer"), F.col("o_custkey").cast("string")).alias("body"),
        F.col("o_orderpriority").alias("category"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN 'deleted' ELSE 'published' END").alias("status"),
        F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'public' ELSE 'project' END").alias("visibility"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("view_count"),
        (F.col("o_orderkey") % 3).alias("like_count"),
        (F.col("o_orderkey") % 2).alias("collect_count"),
        (F.col("o_orderkey") % 4).alias("comment_count"),
        (F.col("o_orderkey") % 2).alias("share_count"),
        F.col("o_orderdate").alias("created_at"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as like / collect / share / comment rows of a note."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("note_id"),
        F.col("l_partkey").alias("user_id"),
        F.expr(
            "CASE WHEN l_returnflag = 'R' THEN 'like' WHEN l_returnflag = 'A' THEN 'collect' "
            "WHEN l_linestatus = 'O' THEN 'share' ELSE 'comment' END"
        ).alias("kind"),
        F.expr("CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END").alias("status"),
        F.col("l_shipdate").alias("created_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as notes with text."""
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("id"),
        (F.lit(1) + F.substring("source", 4, 9).cast("bigint") % 4).alias("project_id"),
        F.col("text").alias("body"),
        F.col("lang").alias("category"),
        "source",
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'project' END").alias("visibility"),
        F.expr("CASE WHEN n_chars % 29 = 0 THEN 'deleted' ELSE 'published' END").alias("status"),
        "n_chars",
        F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id")).alias("created_at"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as comment threads: a turn answers the turn before it."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("id"),
        (F.col("conv_id") + 1).alias("note_id"),
        F.expr("CASE WHEN turn = 0 THEN 0 ELSE conv_id * 1000 + turn END").alias("parent_id"),
        F.expr("CASE WHEN turn = 7 THEN 0 ELSE 1 END").alias("status"),
        F.col("text").alias("content"),
        F.expr("CASE WHEN role = 'system' THEN '' ELSE role END").alias("intent"),
        F.expr("CASE WHEN turn % 2 = 0 THEN 'neutral' ELSE '' END").alias("sentiment"),
        (F.col("turn") % 3).alias("topic_id"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 100 + F.col("turn")).alias("created_at"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as note media: title as caption, markup as recognised text."""
    return table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1).alias("id"),
        (F.col("page_id") + 1).alias("note_id"),
        F.lit("image").alias("media_type"),
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"),
        F.col("html").alias("ocr_text"),
        (F.col("page_id") % 3 + 1).cast("int").alias("position"),
    )


# Tenancy -----------------------------------------------------------------------------

def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``region`` as projects; every second one is private, one is inactive at most."""
    return table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("id"),
        F.col("r_name").alias("name"),
        F.expr("CASE WHEN r_regionkey % 2 = 0 THEN 'public' ELSE 'private' END").alias("visibility"),
        F.expr("CASE WHEN r_regionkey = 4 THEN 'archived' ELSE 'active' END").alias("status"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as project members; customers in debt are inactive."""
    return table(spark, sf_dir, "customer").select(
        (F.lit(1) + F.col("c_nationkey") % 5).cast("bigint").alias("project_id"),
        F.col("c_custkey").alias("user_id"),
        F.expr("CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'left' END").alias("status"),
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` as datasets; each project may have several."""
    return table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("id"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("project_id"),
        F.expr("CASE WHEN n_nationkey < 10 THEN 'community' ELSE lower(n_name) END").alias("slug"),
        F.expr("CASE WHEN n_nationkey < 2 THEN 'archived' ELSE 'active' END").alias("status"),
    )


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` passages as search requests; item number doubles as the user."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.trim(F.col("text")).alias("query"),
        (F.lit(1) + F.col("item_id") % 4).alias("project_id"),
        F.col("item_id").alias("user_id"),
    )


MODEL_SQL: dict[str, str] = {
    "behavior": """
        SELECT 'evt-' || event_id AS source_event_id, 1 + k % 3 AS project_id, user_id,
               nullif(k, 0) AS note_id,
               CASE event_type WHEN 'view' THEN 'note_viewed' WHEN 'click' THEN 'media_viewed'
                    WHEN 'purchase' THEN 'note_collected' WHEN 'signup' THEN 'note_created'
                    WHEN 'error' THEN 'comment_created' ELSE event_type END AS event_type,
               ts AS occurred_at,
               's-' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, event_id, value
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "comment_likes": """
        SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 + user_id % 8 + 1 AS comment_id,
               user_id FROM events WHERE event_type = 'error'""",
    "notes": """
        SELECT o_orderkey + 1 AS id, 1 + o_custkey % 5 AS project_id, o_custkey AS author_id,
               'Note ' || o_orderkey || ' ' || o_orderpriority AS title,
               'Order of customer ' || o_custkey AS body, o_orderpriority AS category,
               CASE WHEN o_orderstatus = 'P' THEN 'deleted' ELSE 'published' END AS status,
               CASE WHEN o_custkey % 2 = 0 THEN 'public' ELSE 'project' END AS visibility,
               CAST(floor(o_totalprice / 1000) AS BIGINT) AS view_count,
               o_orderkey % 3 AS like_count, o_orderkey % 2 AS collect_count,
               o_orderkey % 4 AS comment_count, o_orderkey % 2 AS share_count,
               o_orderdate AS created_at FROM orders""",
    "interactions": """
        SELECT l_orderkey + 1 AS note_id, l_partkey AS user_id,
               CASE WHEN l_returnflag = 'R' THEN 'like' WHEN l_returnflag = 'A' THEN 'collect'
                    WHEN l_linestatus = 'O' THEN 'share' ELSE 'comment' END AS kind,
               CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS status, l_shipdate AS created_at
        FROM lineitem""",
    "docs": """
        SELECT doc_id + 1 AS id, 1 + CAST(substr(source, 4) AS BIGINT) % 4 AS project_id, text AS body,
               lang AS category, source,
               CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'project' END AS visibility,
               CASE WHEN n_chars % 29 = 0 THEN 'deleted' ELSE 'published' END AS status, n_chars,
               TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS created_at FROM documents""",
    "comments": """
        SELECT conv_id * 1000 + turn + 1 AS id, conv_id + 1 AS note_id,
               CASE WHEN turn = 0 THEN 0 ELSE conv_id * 1000 + turn END AS parent_id,
               CASE WHEN turn = 7 THEN 0 ELSE 1 END AS status, text AS content,
               CASE WHEN role = 'system' THEN '' ELSE role END AS intent,
               CASE WHEN turn % 2 = 0 THEN 'neutral' ELSE '' END AS sentiment, turn % 3 AS topic_id,
               TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100 + turn) AS created_at
        FROM conversations""",
    "media": """
        SELECT page_id + 1 AS id, page_id + 1 AS note_id, 'image' AS media_type, url,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS caption, html AS ocr_text,
               CAST(page_id % 3 + 1 AS INTEGER) AS position FROM pages""",
    "projects": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name,
               CASE WHEN r_regionkey % 2 = 0 THEN 'public' ELSE 'private' END AS visibility,
               CASE WHEN r_regionkey = 4 THEN 'archived' ELSE 'active' END AS status FROM region""",
    "members": """
        SELECT CAST(1 + c_nationkey % 5 AS BIGINT) AS project_id, c_custkey AS user_id,
               CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'left' END AS status FROM customer""",
    "datasets": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS project_id,
               CASE WHEN n_nationkey < 10 THEN 'community' ELSE lower(n_name) END AS slug,
               CASE WHEN n_nationkey < 2 THEN 'archived' ELSE 'active' END AS status FROM nation""",
    "queries": """
        SELECT item_id AS query_id, trim(text) AS query, 1 + item_id % 4 AS project_id, item_id AS user_id
        FROM benchmark""",
}

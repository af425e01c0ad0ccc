"""Reader-facing projections: visibility, keyset pages, hydration and thread roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import materialize

SUMMARY_CHARS = 600


def entity_scan(notes: DataFrame) -> DataFrame:
    """Entity rows with missing array and text columns defaulted."""
    defaults = {"array": F.array(), "string": F.lit("")}
    columns = []
    for field in notes.schema.fields:
        kind = field.dataType.typeName()
        fallback = defaults.get(kind)
        column = F.col(field.name)
        if fallback is not None:
            column = F.coalesce(column, fallback.cast(field.dataType)).alias(field.name)
        columns.append(column)
    return notes.select(*columns)


def summary(notes: DataFrame) -> DataFrame:
    """Listing projection: the body is cut to its first characters."""
    return notes.withColumn("body", F.substring("body", 1, SUMMARY_CHARS))


def listed(
    notes: DataFrame, category: str | None = None, project_id: int | None = None, search: str | None = None
) -> DataFrame:
    """Published notes, optionally of one category or project, optionally containing a phrase."""
    result = notes.where("status = 'published'")
    if category is not None:
        result = result.where(F.col("category") == category)
    if project_id is not None:
        result = result.where(F.col("project_id") == project_id)
    if search:
        needle = F.lower(F.lit(search))
        result = result.where(
            F.contains(F.lower("title"), needle) | F.contains(F.lower("body"), needle)
        )
    return result


def visible_to(notes: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """Public rows plus rows of projects the user is an active member of."""
    own = members.where((F.col("user_id") == user_id) & (F.col("status") == "active")).select("project_id")
    public = notes.where("visibility = 'public'")
    private = notes.where("visibility <> 'public'").join(own, "project_id", "left_semi")
    return public.unionByName(private)


def keyset_page(
    rows: DataFrame, order: Sequence[str], after: Sequence[Column] | None, limit: int
) -> DataFrame:
    """One page in descending ``order`` strictly after a cursor, with ``has_more`` on every row.

    One extra row is read to learn whether another page follows.
    """
    if after is not None:
        rows = rows.where(F.struct(*order) < F.struct(*[c.alias(n) for c, n in zip(after, order)]))
    ahead = rows.orderBy(*[F.desc(o) for o in order]).limit(limit + 1)
    numbered = ahead.agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in order])), False).alias("page"))
    return numbered.select(
        (F.size("page") > limit).alias("has_more"),
        F.posexplode(F.slice("page", 1, limit)).alias("position", "row"),
    ).select("has_more", "position", "row.*")


def in_given_order(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows for a table of (request_id, ids array), keeping each list's order."""
    wanted = ids.select("request_id", F.posexplode("ids").alias("position", "id"))
    return wanted.join(rows, "id")


def attach_authors(notes: DataFrame, users: DataFrame) -> DataFrame:
    """Author columns by left join; the planner broadcasts the side when its size allows."""
    return notes.join(users, "author_id", "left")


def viewer_flags(notes: DataFrame, interactions: DataFrame, user_id: int) -> DataFrame:
    """Whether the viewer liked and collected each note."""
    mine = (
        interactions.where((F.col("user_id") == user_id) & F.col("kind").isin("like", "collect"))
        .groupBy(F.col("note_id").alias("id"))
        .agg(F.max(F.col("kind") == "like").alias("_liked"), F.max(F.col("kind") == "collect").alias("_collected"))
    )
    return (
        notes.join(mine, "id", "left")
        .withColumn("liked", F.coalesce("_liked", F.lit(False)))
        .withColumn("collected", F.coalesce("_collected", F.lit(False)))
        .drop("_liked", "_collected")
    )


def note_details(notes: DataFrame, media: DataFrame, users: DataFrame) -> DataFrame:
    """Note with its media in position order and its author.

    A note's media list is bounded by the note itself (an array column of one row).
    """
    per_note = media.groupBy(F.col("note_id").alias("id")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", F.col("id").alias("media_id"), "url"))),
            lambda m: m["url"],
        ).alias("media_urls")
    )
    return attach_authors(notes, users).join(per_note, "id", "left").withColumn(
        "media_urls", F.coalesce("media_urls", F.array().cast("array<string>"))
    )


def thread_roots(comments: DataFrame) -> DataFrame:
    """Root and depth of every comment; a top-level comment has root 0.

    Pointer jumping: each round doubles the distance covered, so a thread of depth d
    takes about log2(d) joins. A reply whose parent is missing keeps that parent as root.
    Comments that are each other's parents have no root: still moving after more rounds than
    any thread of so many comments needs, they are an error.
    """
    links = materialize(
        comments.select(
            "id", F.col("parent_id").alias("top"), F.when(F.col("parent_id") > 0, 1).otherwise(0).cast("bigint").alias("depth")
        )
    )
    for left in range(links.count().bit_length() + 1, -1, -1):
        parents = links.select(
            F.col("id").alias("_id"), F.col("top").alias("_top"), F.col("depth").alias("_depth")
        ).where("_top > 0")
        stepped = links.join(parents, F.col("top") == F.col("_id"), "left").select(
            "id",
            F.coalesce("_top", "top").alias("top"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.col("_top").isNotNull().alias("moved"),
        )
        stepped = materialize(stepped)
        links = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            break
        if not left:
            raise ValueError("some comments are their own ancestors")
    return links.select("id", F.col("top").alias("root_id"), F.col("depth").cast("bigint").alias("depth"))

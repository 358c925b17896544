"""Filtering, sorting and paging of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import mentioned_names, natural_key
from feedloom.sources.shared import write_and_read


def contains_text(query: str, *columns: str) -> Column:
    """Case-insensitive substring over the joined columns; empty ones keep their place."""
    whole = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.lower(whole).contains(query.strip().lower())


def filter_feedback(rows: DataFrame, query: str = "", sentiment: str | None = None, department: str | None = None, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    if sentiment:
        rows = rows.where(F.col("sentiment") == sentiment)
    if department:
        rows = rows.where(F.col("department") == department)
    return rows.where(contains_text(query, *columns)) if query.strip() else rows


def filter_tickets(tickets: DataFrame, status: str | None = None, linked_only: bool = False, query: str = "") -> DataFrame:
    if status:
        tickets = tickets.where(F.col("status") == status)
    if linked_only:
        tickets = tickets.where("n_feedback > 1")
    return tickets.where(contains_text(query, "ticket_id", "category", "description")) if query.strip() else tickets


def filter_marketing(log: DataFrame, with_names: bool = False, query: str = "") -> DataFrame:
    if with_names:
        log = log.where(F.size(mentioned_names(F.col("praise_text"))) > 0)
    return log.where(contains_text(query, "customer_name", "praise_text")) if query.strip() else log


def list_by(rows: DataFrame, condition: Column, limit: int, offset: int = 0) -> DataFrame:
    """Newest first; the id makes the order total."""
    return rows.where(condition).orderBy(F.desc("created_at"), "feedback_id").offset(offset).limit(limit)


def paginate(rows: DataFrame, limit: int = 20, offset: int = 0, newest: str = "created_at", key: str = "feedback_id") -> DataFrame:
    """A page with its number, first and last row and the number of pages."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 rows and starts at 0 or later")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc(newest), key).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumns(  # one row
        {
            "page": F.lit(offset // limit + 1),
            "page_from": F.least(F.lit(offset + 1).cast("long"), F.col("total")),
            "page_to": F.least(F.lit(offset + limit).cast("long"), F.col("total")),
            "pages": F.ceil(F.col("total") / limit),
        }
    )


def sort_nulls_last(rows: DataFrame, column: str, descending: bool = False, tie: str | None = None, collation: str | None = None) -> DataFrame:
    """Nulls last either way; strings compare their numbers by value, and the rest in lower case or
    by ``collation``, as ``UNICODE`` or a locale such as ``de``."""
    c = F.col(column)
    key = natural_key(c, collation) if dict(rows.dtypes)[column] == "string" else c
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last()]
    return rows.orderBy(*order, *([tie] if tie else []))


def positions(ordered: DataFrame) -> DataFrame:
    """Adds ``position`` in a sorted table's order: numbers in parts of the range sort, then added
    up, so that no task gets all rows."""
    numbered = write_and_read(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "positions")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # a row a part
    inside = Window.partitionBy("_part").orderBy("_at")
    return numbered.join(F.broadcast(first), "_part").withColumn("position", (F.col("_first") + F.row_number().over(inside)).cast("long")).drop("_part", "_at", "_first")


def praise_leaderboard(rows: DataFrame, text: str = "text") -> DataFrame:
    """How often each name is praised."""
    names = rows.select(F.explode(mentioned_names(F.col(text))).alias("name"))
    return names.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.count("*").alias("n"))

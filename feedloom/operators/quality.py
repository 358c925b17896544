"""Declared constraints of the five feedback tables, and their violations as rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules as R


@dataclass(frozen=True)
class Constraints:
    """Rules of a table: closed sets, ranges, longest texts, texts that may not be blank, unique
    keys and references (column, table, its column)."""

    key: str
    required: tuple[str, ...] = ()
    enums: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    longest: dict[str, int] = field(default_factory=dict)
    filled: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()


LEVELS = ["low", "medium", "high", "critical"]
TABLES = {
    "feedback": Constraints("feedback_id", ("feedback_id", "source_type"), {"source_type": ["social", "widget"]}, {}, {"text": 10_000}, ("text",), ("feedback_id",)),
    "clusters": Constraints(
        "cluster_id", ("cluster_id", "theme"), {"priority_level": LEVELS, "status": ["active", "monitoring", "resolved"], "sentiment_trend": ["improving", "stable", "deteriorating"]}, {"volume_count": (0, float("inf"))}, {}, (), ("cluster_id",)
    ),
    "analysis": Constraints(
        "feedback_id", ("feedback_id",), {"sentiment_label": R.SENTIMENTS, "priority_level": LEVELS, "intent": R.INTENTS}, {"sentiment_score": (-1, 1), "priority_score": (0, 1)}, {}, (), ("feedback_id",), (("feedback_id", "feedback", "feedback_id"), ("cluster_id", "clusters", "cluster_id"))
    ),
    "tickets": Constraints(
        "ticket_id", ("ticket_id", "ticket_phase"), {"ticket_phase": R.PHASES, "priority_level": LEVELS, "assigned_department": R.DEPARTMENTS, "resolution_type": R.RESOLUTIONS}, {}, {}, (), ("ticket_id",), (("linked_cluster_id", "clusters", "cluster_id"),)
    ),
    "links": Constraints("feedback_id", ("feedback_id", "ticket_id"), {}, {}, {}, (), ("feedback_id",), (("feedback_id", "feedback", "feedback_id"), ("ticket_id", "tickets", "ticket_id"))),
}


def row_violations(df: DataFrame, rules: Constraints, name: str) -> DataFrame:
    """(table_name, key, kind, column_name) of the rules that look at one row."""
    found: list[Column] = []

    def add(kind: str, column: str, bad: Column) -> None:
        found.append(F.when(bad, F.struct(F.lit(kind).alias("kind"), F.lit(column).alias("column_name"))))

    have = set(df.columns)
    for c in rules.required:
        add("not_null", c, F.col(c).isNull())
    for c, allowed in rules.enums.items():
        if c in have:
            add("enum", c, F.col(c).isNotNull() & ~F.col(c).isin(allowed))
    for c, (low, high) in rules.ranges.items():
        if c in have:
            add("range", c, ~F.col(c).between(low, high))
    for c, most in rules.longest.items():
        if c in have:
            add("length", c, F.length(c) > most)
    for c in rules.filled:
        if c in have:
            add("blank", c, F.trim(c) == "")
    each = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v")
    return df.select(F.col(rules.key).cast("string").alias("key"), each).select(F.lit(name).alias("table_name"), "key", "v.kind", "v.column_name")


def table_constraints(tables: dict[str, DataFrame], rules: dict[str, Constraints] = TABLES) -> DataFrame:
    """All violations of ``tables``, a row each; a repeated key is one row, not one a copy."""
    out = None
    for name, df in tables.items():
        r = rules[name]
        parts = [row_violations(df, r, name)]
        for c in r.unique:
            twice = df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1")
            parts.append(twice.select(F.lit(name).alias("table_name"), F.col(c).cast("string").alias("key"), F.lit("unique").alias("kind"), F.lit(c).alias("column_name")))
        for c, other, theirs in r.references:
            if other in tables and c in df.columns:
                known = tables[other].select(F.col(theirs).alias(c)).distinct()
                lost = df.where(F.col(c).isNotNull()).join(known, c, "left_anti")
                parts.append(lost.select(F.lit(name).alias("table_name"), F.col(r.key).cast("string").alias("key"), F.lit("reference").alias("kind"), F.lit(c).alias("column_name")))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out

"""Validation as rules: each is a boolean Column; a report is the union of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of entities and their id prefixes.
PREFIXES = {"character": "char-", "location": "loc-", "faction": "faction-", "item": "item-", "creature": "creature-", "concept": "concept-"}


def prefix_fits(id_: Column, type_: Column) -> Column:
    return F.coalesce(*(F.when(type_ == t, id_.startswith(p)) for t, p in PREFIXES.items()), F.lit(False))


def check(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row does not meet; null does not meet a rule."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(key).alias("key"), F.explode(failed).alias("rule"))


def entity_rules() -> dict[str, Column]:
    c = F.col
    return {"id": F.coalesce(c("id"), F.lit("")) != "", "name": F.coalesce(c("name"), F.lit("")) != "", "type": c("type").isin(*PREFIXES), "prefix": prefix_fits(c("id"), c("type")), "identity": F.coalesce(c("identity"), F.lit("")) != "", "turns": c("first_seen") <= c("last_updated")}


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(section, status, findings): FAIL with the number of findings, or PASS for a check without any."""
    out = None
    for name, found in checks.items():
        one = found.agg(F.count("*").alias("findings")).select(F.lit(name).alias("section"), F.when(F.col("findings") > 0, "FAIL").otherwise("PASS").alias("status"), "findings")
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_relationships(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_id", "target_id").agg(F.count("*").alias("n")).where("n > 1")


def staleness(entities: DataFrame, turn: int) -> DataFrame:
    """Bands of turns since the last update: over 50 FAIL, over 20 WARN."""
    gap = F.lit(turn) - F.col("last_updated")
    return entities.select("id", gap.alias("gap"), F.when(gap > 50, "FAIL").when(gap > 20, "WARN").otherwise("PASS").alias("status"))

"""Per-name summaries of the triples, and the names that hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.operators.salted import HEAVY_SHARE, SALTS, salted_aggregate

FOUND_SHARE = 0.02


def mentions(triples: DataFrame) -> DataFrame:
    """(role, name, partner, relation, batch, at): two rows a triple, one for each role; null names leave."""
    s = F.struct(F.lit("subject").alias("role"), F.col("subject").alias("name"), F.col("object").alias("partner"))
    o = F.struct(F.lit("object").alias("role"), F.col("object").alias("name"), F.col("subject").alias("partner"))
    x = triples.select(F.explode(F.array(s, o)).alias("m"), "relation", "batch", F.col("extracted_at").alias("at"))
    return x.select("m.role", "m.name", "m.partner", "relation", "batch", "at").where("name is not null")


def summarise_names(triples: DataFrame, share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """(role, name, n_rows, n_partners, n_relations, first_at, last_at, last_batch).

    Rows with a null name are left out; repeated rows count. Distinct partners
    and relations are exact: the partial stage gathers them per (role, name,
    partner) and (role, name, relation), which no single name can make uneven,
    and only their counts are merged per name. Null partners and relations are
    no partner and no relation.
    """
    m = mentions(triples)
    base = salted_aggregate(
        m.select("role", "name", "batch", "at", "partner", "relation"),
        ["role", "name"],
        {"n": F.count(F.lit(1)), "lo": F.min("at"), "hi": F.max("at"), "b": F.max("batch")},
        {"n_rows": F.sum("n"), "first_at": F.min("lo"), "last_at": F.max("hi"), "last_batch": F.max("b")},
        share,
        salts,
    )
    parts = m.where("partner is not null").groupBy("role", "name", "partner").agg(F.lit(1).alias("_")).groupBy("role", "name").agg(F.count(F.lit(1)).alias("n_partners"))
    rels = m.where("relation is not null").groupBy("role", "name", "relation").agg(F.lit(1).alias("_")).groupBy("role", "name").agg(F.count(F.lit(1)).alias("n_relations"))
    out = base.join(parts, ["role", "name"], "left").join(rels, ["role", "name"], "left")
    return out.select("role", "name", "n_rows", F.coalesce("n_partners", F.lit(0)).alias("n_partners"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"), "first_at", "last_at", "last_batch")


def names_holding(triples: DataFrame, at_least: float = FOUND_SHARE, share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """(role, name) of every name that holds at least ``at_least`` of all rows of ``triples`` in that role.

    The share is of all rows, those with a null name included; an empty table
    gives no row.
    """
    m = mentions(triples).select("role", "name", "partner", "at")
    per = salted_aggregate(m, ["role", "name"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, share, salts)
    total = triples.agg(F.count(F.lit(1)).alias("total"))
    return per.join(F.broadcast(total), F.col("n") >= F.col("total") * F.lit(at_least)).select("role", "name")

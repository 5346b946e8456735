"""Reference catalogues: models with prices, and nested procedure deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selection import quantiles

# Upper price bounds (USD per million tokens, prompt plus completion) of the tiers.
CHEAP_MAX = 2.25
MID_MAX = 17.50


def price_tier(price: Column) -> Column:
    return F.when(price <= CHEAP_MAX, "$").when(price <= MID_MAX, "$$").otherwise("$$$")


def normalise_models(raw: DataFrame) -> DataFrame:
    """raw: id, name, pricing struct<prompt string, completion string>, context_length."""
    def per_million(field: str) -> Column:
        return F.coalesce(F.expr(f"try_cast(pricing.{field} AS double)"), F.lit(0.0)) * 1_000_000

    both_read = (F.col("pricing.prompt").isNull() | F.expr("try_cast(pricing.prompt AS double)").isNotNull()) & (
        F.col("pricing.completion").isNull() | F.expr("try_cast(pricing.completion AS double)").isNotNull()
    )
    total = F.when(both_read, per_million("prompt") + per_million("completion")).otherwise(F.lit(0.0))
    return (
        raw.filter(F.coalesce(F.col("id"), F.lit("")) != "")
        .select(
            "id",
            F.trim(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id"))).alias("name"),
            F.when(F.col("id").contains("/"), F.split_part("id", F.lit("/"), F.lit(1))).otherwise("").alias("provider"),
            F.round(total, 4).alias("price_per_million"),
            F.round(per_million("prompt"), 4).alias("prompt_per_million"),
            F.round(per_million("completion"), 4).alias("completion_per_million"),
            price_tier(total).alias("tier"),
            F.coalesce("context_length", F.lit(0)).alias("context_length"),
        )
        .orderBy("id")
    )


def tier_bounds(prices: DataFrame, price: str) -> DataFrame:
    """Median and 90th percentile of a price distribution, the basis of the tier bounds; exact at any size."""
    return quantiles(prices, price, p50=0.5, p90=0.9)


# Fixed value: forum -> proceeding -> deadline -> description, rule and required documents.
CATALOGUE_SCHEMA = (
    "map<string, map<string, map<string, struct<description string, rule_citation string, "
    "required_documents array<struct<name string, form_number string, notes string>>>>>>"
)


def flatten_catalogue(raw: DataFrame, column: str = "value") -> DataFrame:
    """Forum, proceeding, deadline and required document as one row each; empty lists keep a row."""
    forums = raw.select(F.explode(F.from_json(column, CATALOGUE_SCHEMA)).alias("forum", "_f"))
    proceedings = forums.select("forum", F.explode("_f").alias("proceeding", "_p"))
    deadlines = proceedings.select("forum", "proceeding", F.explode("_p").alias("deadline", "_d"))
    return deadlines.select(
        "forum", "proceeding", "deadline", "_d.description", "_d.rule_citation",
        F.posexplode_outer("_d.required_documents").alias("doc_no", "_r"),
    ).select("forum", "proceeding", "deadline", "description", "rule_citation", "doc_no", "_r.*")

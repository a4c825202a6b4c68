"""Duplicate entities, ranked, and pairs kept separate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions.words import spaced
from plotline.operators import mentions
from plotline.operators.joins import endpoint_frame
from plotline.session import durable

SCOPE = ["script_id", "entity_type"]


def identifies(name: Column) -> Column:
    """A pronoun, or nothing, identifies nobody."""
    return (name != "") & ~name.isin(*vocab.PRONOUNS)


def _pair(frame: DataFrame, a: str, b: str, reason: str) -> DataFrame:
    return frame.filter(F.col(a) != F.col(b)).select(
        *SCOPE, F.least(a, b).alias("a_id"), F.greatest(a, b).alias("b_id"),
        F.lit(reason).alias("reason"))


def containment_pairs(entities: DataFrame) -> DataFrame:
    """Same-type pairs where one whole name stands inside the other."""
    named = entities.filter(identifies(F.col("normalized_name")))
    outer = named.select(*SCOPE, F.col("entity_id").alias("text_id"),
                         spaced(F.col("normalized_name")).alias("words"))
    inner = named.select(*SCOPE, F.col("entity_id").alias("name_id"),
                         spaced(F.col("normalized_name")).alias("name_words"))
    hits = mentions.phrase_hits(outer, inner, SCOPE)
    # An entity's own name is always found; equal names cannot occur in a scope.
    return _pair(hits, "text_id", "name_id", "one name contains the other").distinct()


def alias_pairs(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs where one name is a recorded surface of the other."""
    named = entities.filter(identifies(F.col("normalized_name")))
    held = (aliases.filter(identifies(F.col("normalized_alias")))
            .join(named.select(*SCOPE, F.col("entity_id").alias("holder_id")),
                  F.col("holder_id") == aliases["entity_id"])
            .select(*SCOPE, "holder_id", F.col("normalized_alias").alias("normalized_name")))
    return _pair(named.join(held, [*SCOPE, "normalized_name"]), "entity_id", "holder_id",
                 "they share a name").distinct()


def cited_counts(assertions: DataFrame) -> DataFrame:
    """A4: active assertions per entity; one citing it on both sides counts once."""
    return endpoint_frame(assertions.filter("active")).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("cited"))


def separated(pairs: DataFrame) -> DataFrame:
    """Unordered pairs stored low id first, each once."""
    return pairs.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")
                        ).filter("a_id <> b_id").dropDuplicates(["a_id", "b_id"])


def detect(entities: DataFrame, aliases: DataFrame, distinctions: DataFrame,
           cited: DataFrame) -> DataFrame:
    """Suspected duplicates with the suggested survivor and a review order.

    Containment is the reason stated when both signals hold. ``degree`` is the
    larger number of matches of either entity: clean decisions sort first.
    """
    found = containment_pairs(entities).unionByName(alias_pairs(entities, aliases))
    pairs = durable(found.groupBy(*SCOPE, "a_id", "b_id").agg(F.min("reason").alias("reason"))
                    .join(separated(distinctions), ["a_id", "b_id"], "left_anti"))
    ends = pairs.select(F.explode(F.array("a_id", "b_id")).alias("entity_id"))
    degree = ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("matches"))
    facts = (entities.select("entity_id", F.char_length("canonical_name").alias("size"))
             .join(cited, "entity_id", "left").join(degree, "entity_id"))

    def side(s):
        return facts.select(F.col("entity_id").alias(f"{s}_id"),
                            F.coalesce("cited", F.lit(0)).alias(f"{s}_cited"),
                            F.col("size").alias(f"{s}_size"), F.col("matches").alias(f"{s}_matches"))
    scored = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    second = (F.col("b_cited") > F.col("a_cited")) | (
        (F.col("b_cited") == F.col("a_cited")) & (F.col("b_size") > F.col("a_size")))
    return scored.select(
        *SCOPE, F.when(second, F.col("b_id")).otherwise(F.col("a_id")).alias("keep_id"),
        F.when(second, F.col("a_id")).otherwise(F.col("b_id")).alias("absorb_id"), "reason",
        F.greatest("a_matches", "b_matches").alias("degree"))

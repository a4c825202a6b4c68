"""The evidence one question is answered from, for a whole table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import names, words
from plotline.operators import joins, mentions
from plotline.operators.filters import first_in
from plotline.session import durable


def packets(questions: DataFrame, surfaces: DataFrame, edges: DataFrame,
            cap: int = vocab.PACKET_ASSERTION_CAP) -> DataFrame:
    """The facts of each question's packet with the tier that scoped them.

    ``questions``: question_id, script_id, text. ``surfaces``: script_id,
    entity_id, name (names and aliases). ``edges``: labelled active assertions
    with script_id, assertion_id, both entity ids and labels, predicate.

    Tier 1 is the edges of entities the question names, tier 2 the edges sharing
    a content word, tier 3 the whole graph. A question that names an entity with
    no edges gets none: that is the answer. Words and names meet edges by equi
    join. The packet keeps the first ``cap`` facts, so the list of an entity, a word or a
    script is cut to its first ``cap`` + 1 before any question meets it: a common word costs a
    question no more than that. ``truncated`` says whether the packet had more.
    """
    folded = names.fold(F.col("text"))
    texts = questions.select("script_id", F.col("question_id").alias("text_id"),
                             words.tokens(folded).alias("words"))
    sought = joins.not_only_stopwords(surfaces.select(
        "script_id", F.col("entity_id").alias("name_id"),
        words.tokens(names.fold(F.col("name"))).alias("name_words")).filter(F.size("name_words") > 0))
    named = durable(mentions.phrase_hits(texts, sought, ["script_id"]).select(
        F.col("text_id").alias("question_id"), F.col("name_id").alias("entity_id")).distinct())
    ends = joins.endpoint_frame(edges).join(edges.select("assertion_id", "script_id"), "assertion_id")
    named = named.join(questions.select("question_id", "script_id"), "question_id")
    by_name = named.join(_firsts(ends, ["script_id", "entity_id"], cap), ["script_id", "entity_id"]).select(
        "question_id", "assertion_id", F.lit(1).alias("tier")).distinct()
    terms = questions.select("script_id", "question_id", F.explode(F.array_distinct(
        words.content_terms(F.col("text")))).alias("word"))
    unnamed = terms.join(named.select("question_id").distinct(), "question_id", "left_anti")
    edge_words = edges.select("script_id", "assertion_id", F.explode(words.edge_words(
        F.concat_ws(" ", "subject_label", "predicate", "object_label"))).alias("word"))
    by_word = durable(unnamed.join(_firsts(edge_words, ["script_id", "word"], cap), ["script_id", "word"]).select(
        "question_id", "assertion_id", F.lit(2).alias("tier")).distinct())
    scoped = named.select("question_id").union(by_word.select("question_id")).distinct()
    rest = questions.join(scoped, "question_id", "left_anti").select("question_id", "script_id")
    # A question that scopes nothing reads its script's first facts.
    head = _firsts(edges.select("script_id", "assertion_id"), ["script_id"], cap)
    whole = rest.join(head, "script_id").select("question_id", "assertion_id", F.lit(3).alias("tier"))
    found = by_name.unionByName(by_word).unionByName(whole)
    ranked = durable(first_in(found, ["question_id"], [F.col("assertion_id")], cap + 1, "item_rank"))
    more = ranked.filter(F.col("item_rank") > cap).select("question_id", F.lit(True).alias("_more"))
    return ranked.filter(F.col("item_rank") <= cap).join(more, "question_id", "left").withColumn(
        "truncated", F.coalesce("_more", F.lit(False))).drop("_more")


def _firsts(lists: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """The first facts of each list, one more than a packet takes."""
    return first_in(lists.select(*keys, "assertion_id").distinct(), keys, [F.col("assertion_id")], cap + 1, "_k").drop("_k")


def facts(scripts: DataFrame, scenes: DataFrame, entities: DataFrame, assertions: DataFrame) -> DataFrame:
    """The totals a packet states; every scene in play counts, cited or not."""
    from plotline.operators.aggregates import counts_with_zero
    return counts_with_zero(scripts.select("script_id", "title"), "script_id",
                            scenes=scenes.filter(~F.col("omitted")), entities=entities,
                            assertions=assertions.filter("active"))

"""Name-in-text joins without all-pairs work.

A name is found in a text by an equi join: the text offers its word n-grams (or
character grams), the name offers one key of at most that length, and longer
names are verified after the join. No name length is out of reach and no pair
is formed that does not share the key. The names are counted first: few are
broadcast, otherwise both sides shuffle on the gram. The planner does not see how
many grams a text has and would take them for the small side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.text import word_ngrams

LONGEST = 3
CHARS = 4
FEW = 50_000


def _sizes(names: DataFrame, size: Column, most: int) -> dict[int, int]:
    """How many names have each size, those above ``most`` together: a few values."""
    counted = names.groupBy(F.least(size, F.lit(most + 1)).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    return {r.n: r.k for r in counted.collect()}


def _side(names: DataFrame, sizes: dict[int, int]) -> DataFrame:
    return F.broadcast(names) if sum(sizes.values()) <= FEW else names.hint("merge")


def phrase_hits(texts: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Texts that hold a name's words in a row.

    ``texts``: text_id, words (array), plus keys. ``names``: name_id, name_words
    (array, not empty), plus keys. Returns text_id, name_id, keys, distinct.
    """
    keys = keys or []
    sizes = _sizes(names, F.size("name_words"), LONGEST)
    asked = sorted({min(n, LONGEST) for n in sizes})
    grams = texts.select(
        *keys, "text_id", F.explode(word_ngrams(F.col("words"), asked or [1])).alias("gram"))
    anchored = names.withColumn("gram", F.array_join(F.slice("name_words", 1, LONGEST), " "))
    short = grams.join(_side(anchored.filter(F.size("name_words") <= LONGEST), sizes), [*keys, "gram"])
    # Only texts that hold a long name's opening are looked at again in full.
    long = (grams.join(_side(anchored.filter(F.size("name_words") > LONGEST), sizes), [*keys, "gram"])
            .join(texts.hint("merge"), [*keys, "text_id"])
            .filter(F.contains(
                F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")),
                F.concat(F.lit(" "), F.array_join("name_words", " "), F.lit(" ")))))
    wanted = [*keys, "text_id", "name_id"]
    found = short.select(*wanted)
    if max(sizes, default=0) > LONGEST:
        found = found.unionByName(long.select(*wanted))
    return found.distinct()


def all_words_hits(texts: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Texts that hold every word of a name, in any order.

    ``words`` and ``name_words`` are sets. A name meets texts only through its
    rarest word among all texts; its other words are looked up in the texts that
    hold that one. A name with a word no text holds meets nothing.
    """
    keys = keys or []
    offered = texts.select(*keys, "text_id", F.explode("words").alias("word"))
    sought = names.filter(F.size("name_words") > 0).select(*keys, "name_id", "name_words")
    parts = sought.select(*keys, "name_id", "name_words", F.explode("name_words").alias("word"))
    held = (offered.join(parts.select(*keys, "word").distinct(), [*keys, "word"], "left_semi")
            .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("_held")))
    rarest = parts.join(held, [*keys, "word"]).groupBy(*keys, "name_id").agg(
        F.min_by(F.struct("word", "name_words"), F.struct("_held", "word")).alias("_r")).select(
        *keys, "name_id", "_r.word", "_r.name_words")
    near = offered.join(rarest, [*keys, "word"]).drop("word")
    return (near.join(texts, [*keys, "text_id"])
            .filter(F.size(F.array_except("name_words", "words")) == 0).select(*keys, "text_id", "name_id"))


def _grams(text: Column, n: int) -> Column:
    length = F.char_length(text)
    return F.when(length >= n, F.transform(
        F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))


def substring_hits(texts: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Short texts (headings) that hold a name anywhere, word-aligned or not.

    ``texts``: text_id, text; ``names``: name_id, name (not empty). The key is
    the name's first four characters; what follows is verified after the join.
    """
    keys = keys or []
    sizes = _sizes(names, F.char_length("name"), CHARS)
    asked = sorted({min(n, CHARS) for n in sizes}) or [CHARS]
    grams = texts.select(*keys, "text_id", "text", F.explode(F.array_distinct(F.concat(
        *[_grams(F.col("text"), n) for n in asked]))).alias("gram"))
    anchored = names.withColumn("gram", F.left("name", F.lit(CHARS)))
    return (grams.join(_side(anchored, sizes), [*keys, "gram"]).filter(F.contains("text", F.col("name")))
            .drop("gram"))


def whole_word(text: Column, phrase: Column) -> Column:
    """The phrase between word boundaries."""
    pattern = F.concat(F.lit(r"(?U)\b\Q"), phrase, F.lit(r"\E\b"))
    return F.rlike(text, pattern)


def name_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def ungrounded_names(answers: DataFrame, grounded: DataFrame, names: DataFrame) -> DataFrame:
    """Names an answer states outside the names it was grounded in.

    ``answers``: answer_id, answer. ``grounded``: answer_id, name. ``names``: name.
    A name containing, or contained in, a grounded one is the same mention.
    """
    lowered = answers.select("answer_id", F.lower("answer").alias("text"))
    keyed = (names.select("name", F.lower("name").alias("key")).distinct()
             .filter(F.char_length("key") >= 3))
    texts = lowered.select(F.col("answer_id").alias("text_id"), name_tokens(F.col("text"))
                           .alias("words"))
    sought = keyed.select(F.col("name").alias("name_id"), name_tokens(F.col("key"))
                          .alias("name_words")).filter(F.size("name_words") > 0)
    found = phrase_hits(texts, sought).select(
        F.col("text_id").alias("answer_id"), F.col("name_id").alias("name"),
        F.lower("name_id").alias("key"))
    # One row an answer, so never broadcast, whatever the planner makes of a well packed file.
    stated = found.join(lowered.hint("merge"), "answer_id").filter(whole_word(F.col("text"), F.col("key")))
    known = grounded.select("answer_id", F.lower("name").alias("g"))
    same = F.contains("key", F.col("g")) | F.contains("g", F.col("key"))
    excused = stated.join(known.hint("merge"), "answer_id").filter(same).select("answer_id", "name").distinct()
    return stated.select("answer_id", "name").join(excused.hint("merge"), ["answer_id", "name"], "left_anti")

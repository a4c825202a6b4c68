"""the sentences that reports and findings state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each manner of appearance is put in words.
MANNER_WORDS = {
    "on_stage": "on stage",
    "referenced": "named but not present",
    "depicted": "shown only in a photograph, recording, or the like"}


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def orphan_message(label: Column, scenes: Column) -> Column:
    """``scenes`` is the array of scene labels still using the entity."""
    return F.concat(label, F.lit(" is used in scene"), plural(F.size(scenes), "", "s"),
                    F.lit(" "), F.array_join(scenes, ", "), F.lit(" but no longer introduced."))


def rename_message(old: Column, new: Column, lines: Column, scenes: Column) -> Column:
    shown = F.filter(scenes, lambda s: (s != "") & (s != "—"))
    where = F.when(F.size(shown) > 0, F.concat(
        F.lit(" in scene"), plural(F.size(shown), "", "s"), F.lit(" "),
        F.array_join(shown, ", "))).otherwise("")
    only = F.concat(old, F.lit(" is renamed "), new,
                    F.lit(" on this line, the only line that named "), old,
                    F.lit(". Rebuild the graph to record "), new, F.lit(" as the character."))
    rest = F.concat(old, F.lit(" is renamed "), new, F.lit(" on this line, but "), lines,
                    F.lit(" other line"), plural(lines, "", "s"), where, F.lit(" still name"),
                    plural(lines, "s", ""), F.lit(" "), old, F.lit("."))
    return F.when(lines == 0, only).otherwise(rest)


def edge_phrase(subject: Column, predicate: Column, obj: Column, manner: Column) -> Column:
    edge = F.concat_ws(" ", subject, predicate, obj)
    spelled = F.create_map(*[F.lit(x) for kv in MANNER_WORDS.items() for x in kv])[manner]
    return F.when((predicate == "appears_in") & spelled.isNotNull(),
                  F.concat(edge, F.lit(" ("), spelled, F.lit(")"))).otherwise(edge)


def draft_rename_message(old: Column, new: Column, moved: Column, mapped: Column) -> Column:
    return F.concat(old, F.lit(" appears renamed to "), new, F.lit(": "), moved, F.lit(" of "),
                    mapped, F.lit(" of "), old, F.lit("'s carried speaking positions now read "),
                    new, F.lit("."))


def preview_summary(changed: Column, removed: Column, added: Column, messages: Column) -> Column:
    """what a proposal changes, in numbers; ``changed`` is an array of struct(before, after) labels.

    The first three swaps are named and the first two findings follow.
    """
    swaps = F.array_join(F.transform(F.slice(changed, 1, 3), lambda c: F.concat(
        c["before"], F.lit(" becomes "), c["after"])), ", ")
    parts = F.array_compact(F.array(
        F.when(F.size(changed) > 0, F.concat(F.lit("Changes "), F.size(changed), F.lit(" requirement(s): "), swaps, F.lit("."))),
        F.when(removed > 0, F.concat(F.lit("Removes "), removed, F.lit(" assertion(s)."))),
        F.when(added > 0, F.concat(F.lit("Adds "), added, F.lit(" assertion(s).")))))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("No graph change.")))
    said = F.filter(F.slice(messages, 1, 2), lambda m: m != "")
    return F.array_join(F.concat(parts, said), " ")


def answer_line(title: Column, scenes: Column, entities: Column, assertions: Column, matching: Column, named: Column) -> Column:
    """the script's totals and the matching assertions, put without a model.

    ``named``: the distinct scene labels of the matches, in the order first met.
    """
    prefix = F.concat(F.coalesce(title, F.lit("The script")), F.lit(": "), scenes, F.lit(" scene(s), "), entities,
                      F.lit(" entities, "), assertions, F.lit(" accepted assertions. "))
    where = F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("unknown")
    return F.concat(prefix, matching, F.lit(" accepted assertion(s) match, across scene(s) "), where,
                    F.lit(". Configure a model in Settings for a written answer."))

"""Graph, change, draft and merge dataflows on hand-made frames and against brute force."""

import random
import re
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotline.functions import headings, names, replies, similarity
from plotline.operators import quality
from plotline.plans import changes, continuity, diff, drafts, merge, seed, verdicts
from plotline.registry import corpora
from plotline.sources import truth
from plotline.sources.tables import Tables

EDGE = ("change_set_id int, subject_kind string, subject_key string, predicate string, object_kind string, object_key string, "
        "subject_type string, object_type string, confidence double, source_unit_id string, assertion_id string, manner string, "
        "position int")


def edge(subject, predicate, obj, kind="prop", at=0, subject_kind="scene"):
    return (1, subject_kind, subject, predicate, "entity", obj, None if subject_kind == "scene" else "cast", kind, 0.9, "u",
            f"{subject}{predicate}{obj}", None, at)


def states(spark, old, new):
    frame = lambda rows: spark.createDataFrame(rows, EDGE)
    got = diff.diff_edges(frame(old), frame(new)).collect()
    return sorted((r.state, r.object_key, r.new_object_key) for r in got)


def test_diff_pairs_only_one_of_each(spark):
    old = [edge("1", "requires", "lamp"), edge("2", "requires", "a"), edge("2", "requires", "b")]
    new = [edge("1", "requires", "torch"), edge("2", "requires", "c")]
    assert states(spark, old, new) == [("added", "c", None), ("changed", "lamp", "torch"), ("removed", "a", None),
                                       ("removed", "b", None)]
    assert states(spark, [edge("1", "requires", "lamp", "prop")], [edge("1", "requires", "crash", "stunt")]) == [
        ("added", "crash", None), ("removed", "lamp", None)]


def test_diff_of_equal_sets_is_empty_and_symmetric_edges_match(spark):
    rows = [edge("1", "requires", "lamp"), edge("2", "uses", "cup")]
    assert {s[0] for s in states(spark, rows, rows)} == {"unchanged"}
    a = [edge("ann", "interacts_with", "bob", "cast", subject_kind="entity")]
    b = [edge("bob", "interacts_with", "ann", "cast", subject_kind="entity")]
    assert [s[0] for s in states(spark, a, b)] == ["unchanged"]


def test_diff_deals_edges_once_and_hot_change_sets_agree(spark):
    import random
    rng = random.Random(5)
    def some(n):
        return [edge(str(rng.randint(0, 9)), rng.choice(["requires", "uses"]), rng.choice("abcdefg"), rng.choice(["prop", "cast", None])) for _ in range(n)]
    both = [spark.createDataFrame(some(60), EDGE).withColumn("change_set_id", F.expr("int(rand(3) * 4)")).withColumn(
        "position", F.monotonically_increasing_id()) for _ in "ab"]
    both = [spark.createDataFrame(b.collect(), b.schema) for b in both]
    both[0] = both[0].unionByName(both[0].limit(2).withColumn("change_set_id", F.lit(None).cast("int")))
    rows = lambda hot: sorted(map(str, diff.diff_edges(*both, hot_rows=hot).select("change_set_id", *diff.IDENTITY, "state", "new_object_key", "before", "after").collect()))
    assert rows(None) == rows(0) == rows(30)
    assert {x for x in ("unchanged", "changed", "removed", "added") if any(x in r for r in rows(None))} == {"unchanged", "changed", "removed", "added"}
    plan = diff.diff_edges(*both)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1


FACT = ("assertion_id string, script_id int, subject_kind string, subject_entity_id int, subject_scene_id int, predicate string, "
        "object_kind string, object_entity_id int, object_scene_id int, source_unit_id string, confidence double, active boolean")


def test_apply_then_undo_is_identity(spark):
    base = spark.createDataFrame([("a", 1, "scene", None, 1, "requires", "entity", 5, None, "u1", 0.9, True),
                                  ("b", 1, "scene", None, 1, "requires", "entity", 6, None, "u1", 0.8, True)], FACT)
    op = ("change_set_id int, accepted_order int, sequence_index int, operation_type string, target_type string, target_id string, "
          "script_id int, subject_kind string, subject_entity_id int, subject_scene_id int, predicate string, object_kind string, "
          "object_entity_id int, object_scene_id int, source_unit_id string, confidence double, before_json string, after_json string")
    ops = spark.createDataFrame([(1, 1, 0, "remove_assertion", "assertion", "a", 1, None, None, None, None, None, None, None, None,
                                  None, "{}", None)], op)
    after = changes.apply_assertions(base, ops)
    assert {r.assertion_id: r.active for r in after.collect()} == {"a": False, "b": True}
    undo = changes.inverse_operations(ops).withColumns({
        "accepted_order": F.lit(2), "script_id": F.lit(1), "source_unit_id": F.lit(None).cast("string"),
        "confidence": F.lit(None).cast("double"), **{c: F.lit(None).cast("int") for c in (
            "subject_entity_id", "subject_scene_id", "object_entity_id", "object_scene_id")},
        **{c: F.lit(None).cast("string") for c in ("subject_kind", "predicate", "object_kind")}})
    back = changes.apply_assertions(after, undo)
    assert sorted(map(str, back.select(*base.columns).collect())) == sorted(map(str, base.collect()))


def test_operations_of_repeated_lines_need_no_join_of_the_table_with_itself(spark):
    from plotline.registry import changes as queries
    from tests.test_queries import FOLDER
    t = Tables(spark, FOLDER)
    plain = t.lineitem.limit(300)
    t.lineitem = spark.createDataFrame(plain.union(plain.limit(60).withColumns({
        "l_quantity": F.lit(3.0), "l_returnflag": F.lit("R"), "l_shipdate": F.expr("l_shipdate + INTERVAL 9 DAYS")})).collect(), plain.schema)
    got = queries.operations(t)
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    want = t.assertions.join(t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("target_id"), "l_quantity",
                                               days.alias("day")), F.col("target_id") == F.col("assertion_id")).filter("l_quantity > 40 OR l_quantity < 10")
    kept = ["target_id", "predicate", "script_id", "subject_entity_id", "subject_scene_id"]
    assert sorted(map(str, want.select(*kept, "day", (F.col("l_quantity") < 10).alias("up")).collect())) == sorted(map(str, got.select(
        *kept, F.col("accepted_order").alias("day"), (F.col("operation_type") == "update_assertion").alias("up")).collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_update_reuses_the_row_of_an_existing_edge(spark):
    base = spark.createDataFrame([("a", 1, "scene", None, 1, "requires", "entity", 5, None, "u1", 0.9, True),
                                  ("b", 1, "scene", None, 1, "requires", "entity", 6, None, "u1", 0.8, False)], FACT)
    ops = base.filter("assertion_id = 'b'").withColumns({
        "operation_type": F.lit("update_assertion"), "target_id": F.lit("a"), "accepted_order": F.lit(1),
        "sequence_index": F.lit(0), "confidence": F.lit(0.5)})
    got = {r.assertion_id: (r.active, r.confidence) for r in changes.apply_assertions(base, ops).collect()}
    assert got == {"a": (False, 0.9), "b": (True, 0.5)}


def test_orphans_ignore_uses_the_same_edit_removes(spark):
    rows = [("i", 1, "scene", None, 1, "establishes", "entity", 5, None, "u1", 0.9, True),
            ("u", 1, "scene", None, 2, "requires", "entity", 5, None, "u2", 0.9, True),
            ("j", 1, "scene", None, 1, "establishes", "entity", 6, None, "u1", 0.9, True),
            ("v", 1, "scene", None, 1, "requires", "entity", 6, None, "u1", 0.9, True)]
    facts = spark.createDataFrame(rows, FACT).withColumn("in_scene", F.col("subject_scene_id")).withColumn(
        "scene_label", F.col("subject_scene_id").cast("string"))
    removed = spark.createDataFrame([(1, "i"), (1, "j"), (1, "v"), (1, None)], "change_set_id int, assertion_id string")
    labels = spark.createDataFrame([(5, "Lamp"), (6, "Cup")], "entity_id int, label string")
    found = continuity.orphan_findings(continuity.orphaned(removed, facts), labels).collect()
    assert [r.message for r in found] == ["Lamp is used in scene 2 but no longer introduced."]


def test_listed_facts_compare_names_before_facts_meet_batches(spark):
    edits = spark.createDataFrame([("b", 1, 1, "u1", 0, "the", "red lantern"), ("b", 1, 2, "u2", 1, "a", None), ("c", 2, 1, "u9", 0, "red lantern", "x"),
                                   ("d", 1, 2, "u5", 0, "a", "b")], "batch_id string, script_id int, scene_id int, unit_id string, position int, "
                                  "current_text string, proposed_text string")
    facts = spark.createDataFrame([("f", 1, 5, 6, "u7", True), ("g", 2, None, 5, "u2", True), ("h", 1, None, 6, "u8", True), ("i", 1, None, 5, "u8", False),
                                   ("j", 1, None, 7, "u8", True)], "assertion_id string, unit_scene_id int, subject_entity_id int, object_entity_id int, "
                                  "source_unit_id string, active boolean")
    surfaces = spark.createDataFrame([(1, 5, "Red Lantern"), (1, 6, "blue lantern"), (2, 7, "lantern"), (None, 6, "lantern"), (1, 6, "of")],
                                     "script_id int, entity_id int, name string")
    out = verdicts.listed_facts(edits, facts, surfaces)
    assert sorted(map(tuple, out.collect())) == [("b", "f", 1), ("b", "g", 0), ("c", "j", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3


def test_listed_pairs_are_made_distinct_where_they_meet(spark):
    """no aggregate, so no exchange, stands above both ways; a cited fact is not listed again for its names."""
    edits = spark.createDataFrame([("b", 1, 1, "u1", 0, "red", "lantern"), ("b", 1, 1, "u1", 1, "old", "house"), ("b", 2, 1, "u3", 2, "x", "lantern"),
                                   ("e", None, 1, None, 0, "red lantern", "a")], "batch_id string, script_id int, scene_id int, unit_id string, "
                                  "position int, current_text string, proposed_text string")
    facts = spark.createDataFrame([("cited", 1, 5, None, "u1", True), ("both", 1, 5, 6, "u7", True), ("apart", 1, 7, None, "u8", True),
                                   ("loose", 1, 6, None, None, True), ("other", 2, 5, None, "u9", True)], "assertion_id string, unit_scene_id int, "
                                  "subject_entity_id int, object_entity_id int, source_unit_id string, active boolean")
    surfaces = spark.createDataFrame([(1, 5, "Red Lantern"), (1, 5, "lantern"), (1, 6, "old house"), (2, 7, "house lantern")],
                                     "script_id int, entity_id int, name string")
    out = verdicts.listed_facts(edits, facts, surfaces)
    assert sorted(map(tuple, out.collect())) == [("b", "both", 1), ("b", "cited", 0), ("b", "loose", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_changed_lines_tell_a_facts_ends_without_a_join(spark):
    scenes = spark.createDataFrame([(1, 0, -1, "modified"), (2, 0, -2, "unchanged")], "scene_id int, script_id int, predecessor_scene_id int, lineage_kind string")
    units = spark.createDataFrame([("u", 1, "new", "o"), ("o", -1, "old", None), ("v", 2, "new", "o")], "unit_id string, scene_id int, text string, "
                                  "predecessor_unit_id string")
    facts = spark.createDataFrame([("a", 3, 4, True, 1), ("b", None, 5, True, -1), ("c", None, 6, False, 1), ("d", 7, 7, True, 2)],
                                  "assertion_id string, subject_entity_id int, object_entity_id int, active boolean, unit_scene_id int")
    carried = spark.createDataFrame([(0, 50, 5), (0, 30, 3)], "script_id int, entity_id int, predecessor_entity_id int")
    lines, affected = drafts.changed_lines(scenes, units, facts, carried)
    assert [r.unit_id for r in lines.collect()] == ["u"]
    assert sorted(map(tuple, affected.select("scene_id", "entity_id").collect())) == [(1, 3), (1, 4), (1, 50)]
    # Per side: edited scenes with their lines (three) and their facts; and the carried entities.
    assert affected._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 9


def test_merge_chain_and_skipped_pairs(spark):
    pairs = spark.createDataFrame([(1, 10, 11), (2, 12, 11), (3, 9, 10), (4, 11, 13), (5, 20, 21)],
                                  "position int, keep_id int, absorb_id int")
    applied = merge.in_force(pairs)
    assert sorted(r.position for r in applied.collect()) == [1, 3, 5]
    root = {r.entity_id: r.root_id for r in merge.roots(applied).collect()}
    assert root == {11: 9, 10: 9, 21: 20}


def naive_in_force(pairs):
    gone, out = set(), []
    for position, keep, absorb in sorted(pairs):
        if keep not in gone and absorb not in gone:
            gone.add(absorb)
            out.append(position)
    return out


def test_merge_batch_matches_one_by_one(spark):
    rng = random.Random(5)
    pairs = [(i, *rng.sample(range(12), 2)) for i in range(25)]
    got = merge.in_force(spark.createDataFrame(pairs, "position int, keep_id int, absorb_id int"))
    assert sorted(r.position for r in got.collect()) == naive_in_force(pairs)


def test_resolution_in_order(spark):
    rows = pd.DataFrame([(-1, "cast", 1, "mary", True, []), (0, "cast", 1, "lubov", False, []),
                         (1, "cast", 1, "lubov andreyevna", False, ["luba"]), (2, "cast", 1, "luba", False, []),
                         (3, "cast", 1, "mary anne", False, []), (4, "cast", 1, "mary jane", False, []),
                         (5, "cast", 1, "maras", False, [])],
                        columns=["position", "entity_type", "script_id", "normalized_name", "known", "aliases"])
    got = merge.resolve_in_order(rows).set_index("normalized_name")
    assert list(got["how"]) == ["new", "extension", "alias", "extension", "extension", "new"]
    assert got.loc["lubov andreyevna", "target_name"] == "lubov" and got.loc["luba", "target_name"] == "lubov"


def full_table(old, new, floor):
    """The order-preserving alignment by its definition: the best total over all chains."""
    score = [[0.3 * SequenceMatcher(None, a[0], b[0]).ratio() + 0.7 * SequenceMatcher(None, a[1], b[1]).ratio() for b in new] for a in old]
    best = {}

    def go(i, j):
        if i == len(old) or j == len(new):
            return 0.0
        if (i, j) not in best:
            take = score[i][j] + go(i + 1, j + 1) if score[i][j] >= floor else 0.0
            best[i, j] = max(go(i + 1, j), go(i, j + 1), take)
        return best[i, j]
    return go(0, 0)


def test_similarity_alignment_reaches_the_best_total(spark):
    rng = random.Random(3)
    words = "rain falls on the old tin roof while anna waits by door".split()
    old = [("int. a", " ".join(rng.choices(words, k=9))) for _ in range(7)]
    new = [(h, " ".join(w if rng.random() < 0.8 else "x" for w in b.split())) for h, b in old[2:] + old[:2]]
    frame = lambda rows, s: spark.createDataFrame(
        [(1, f"{s}{i}", i, None, h, [b]) for i, (h, b) in enumerate(rows)],
        "pair_id int, scene_id string, position int, number string, heading string, texts array<string>")
    for floor in (0.5, 0.65):
        got = drafts.similar(frame(old, "o"), frame(new, "n"), floor).collect()
        assert abs(sum(r.score for r in got) - full_table(old, new, floor)) < 1e-9


def test_alignment_passes(spark):
    scenes = lambda rows, s: spark.createDataFrame(
        [(1, f"{s}{i}", i, n, h, t) for i, (n, h, t) in enumerate(rows)],
        "pair_id int, scene_id string, position int, number string, heading string, texts array<string>")
    old = scenes([("1", "INT. A", ["one"]), ("2", "INT. B", ["two words here"]), ("3", "INT. C", ["three"]), ("4", "INT. D", ["zzz"])], "o")
    new = scenes([("1", "int. a", [" one"]), ("2", "INT. B", ["rewritten"]), ("3", "OMITTED", []), ("9", "INT. Q", ["brand new text"])], "n")
    got = drafts.align(old, new)
    assert sorted((r.old_id, r.new_id, r.kind, r.method) for r in got["pairs"].collect()) == [
        ("o0", "n0", "unchanged", "content"), ("o1", "n1", "modified", "number")]
    assert sorted(r.old_id for r in got["deleted"].collect()) == ["o2", "o3"]
    assert [r.new_id for r in got["inserted"].collect()] == ["n3"]


def test_line_alignment(spark):
    units = spark.createDataFrame([(1, 0, "a", "Rain."), (1, 1, "b", "She waits by the door."), (1, 2, "c", "End."),
                                   (2, 0, "x", "Rain."), (2, 1, "y", "She waits by a door."), (2, 2, "z", "Q"), (2, 3, "w", "End.")],
                                  "scene_id int, sequence_index int, unit_id string, text string")
    pairs = spark.createDataFrame([(1, 2)], "old_id int, new_id int")
    got = {(r.new_unit_id, r.old_unit_id, r.same) for r in drafts.align_lines(pairs, units).collect()}
    assert got == {("x", "a", True), ("w", "c", True), ("y", "b", False)}


def test_word_diff_and_ratio(spark):
    df = spark.createDataFrame([("the red cup falls", "the blue cup falls down")], "a string, b string")
    row = df.select(similarity.word_diff("a", "b").alias("d"), similarity.ratio("a", "b").alias("r")).first()
    assert [(s.op, s.text) for s in row.d] == [("equal", "the"), ("del", "red"), ("ins", "blue"), ("equal", "cup falls"), ("ins", "down")]
    assert row.r == SequenceMatcher(None, "the red cup falls", "the blue cup falls down").ratio()


def test_location_of_setting(spark):
    cases = {"[SCENE: Elsinore. A platform before the Castle. Night.]": "Elsinore. A platform before the Castle",
             "In a field.": "In a field", "_A room which is still the nursery. Doors._": "A room which is still the nursery",
             "x" * 200: "x" * 200}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.loc for r in df.select("s", headings.location_of(F.col("s")).alias("loc")).collect()} == cases


def test_names(spark):
    cases = {"THE BLUE SEDAN": "blue sedan", "Blue Sedan (2)": "blue sedan", "Straße.": "strasse", "ＭＡＲＡ": "mara",
             "O\u2019Neil \u2013 the Elder;": "o'neil - the elder", "a an apple": "an apple"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in df.select("s", names.normalize(F.col("s")).alias("n")).collect()} == cases


def test_replies_must_be_one_object(spark):
    cases = {'{"a": 1}': True, '{"a": 1}}': False, '{"a": 1}]': False, '{"a": 1} {"b": 2}': False, '[1]': False, "": False, "nope": False,
             '{"a": 1}, {"b": 2}': False}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.ok for r in df.select("s", replies.json_object(F.col("s")).isNotNull().alias("ok")).collect()} == cases


def test_unusable_names(spark):
    cases = [("Two men", "cast", "pronoun_or_group_name"), ("Six monitors", "prop", None), ("Dr. Chen", "cast", None),
             ("UPDATED. Contact us", "cast", "sentence_like_name"), ("SMITH, JR.", "cast", None),
             ("The table is set", "location", "descriptive_location"), ("A room which is called home", "location", None),
             ("OMITTED", "location", "not_a_place"), ("Next day at 11 a.m", "location", "names_a_time"),
             ("After the storm", "location", "names_a_circumstance"), ("Elsinore. A platform", "location", None)]
    df = spark.createDataFrame(cases, "n string, t string, want string")
    got = df.select("n", "want", quality.unusable_name(F.col("n"), F.col("t")).alias("got")).collect()
    assert [(r.n, r.got) for r in got] == [(r.n, r.want) for r in got]


def test_verdict_guards(spark):
    listed = spark.createDataFrame([
        (1, 1, "Mara", [], 7, "Boots on wet concrete", [], 8, "u1", "Boots on wet concrete"),
        (1, 2, "Mara", [], 7, "Blue sedan", [], 9, "u1", ""), (1, 3, "Mara", [], 7, "Lantern", [], 10, "u9", ""),
        (1, 4, "Sc 14", [], None, "Knife", ["blade"], 11, "u9", "")],
        "batch_id int, item_id int, subject string, subject_names array<string>, subject_entity_id int, object string, "
        "object_names array<string>, object_entity_id int, source_unit_id string, evidence string")
    edits = spark.createDataFrame([(1, "u1", 0, "Mara: boots on wet concrete, a blue sedan.", "Mara: boots on wet ground, a sedan. The blade.")],
                                  "batch_id int, unit_id string, position int, current_text string, proposed_text string")
    said = spark.createDataFrame([(1, 1, 0, "holds", None), (1, 2, 1, "removed", None), (1, 3, 2, "removed", None), (1, 4, 3, "removed", None),
                                  (1, 9, 4, "holds", None), (1, 1, 5, "removed", None)],
                                 "batch_id int, item_id int, position int, verdict string, new_value string")
    stored = spark.createDataFrame([(1, 9, "blue")], "batch_id int, entity_id int, value string")
    final, rejected = verdicts.verify_assertions(listed, said, edits, stored)
    assert {r.item_id: (r.final, r.reason) for r in final.collect()} == {
        1: ("removed", "vanished_evidence"), 2: ("holds", "not_visible"), 3: ("removed", None), 4: ("removed", None)}
    assert sorted((r.item_id, r.reason) for r in rejected.collect()) == [(1, "duplicate"), (9, "unlisted")]


def test_seeding_twice_writes_nothing(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    frames = truth.routed(truth.tables(corpora.truth_texts(t)))
    scenes = t.part.select(F.col("p_partkey").alias("doc_id"), F.lit("5").alias("number"), F.col("p_partkey").alias("scene_id"),
                           F.lit("INT. HALL").alias("heading"))
    units = scenes.select("scene_id", F.concat(F.lit("u"), "scene_id").alias("unit_id"), F.lit(0).alias("sequence_index"),
                          F.lit("text").alias("text"), F.lit(None).cast("string").alias("speaker"))
    _, edges, _ = seed.seed(frames, scenes, units)
    first = edges.withColumn("active", F.lit(True))
    assert first.count() > 0
    _, again, _ = seed.seed(frames, scenes, units, first)
    assert again.count() == 0


def test_rows_do_not_depend_on_partitions(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    from plotline.operators import scans
    order = [F.col("ts"), F.col("event_id")]
    one = scans.ordinal(t.events.repartition(1), ["event_type"], order, "n", 10)
    many = scans.ordinal(t.events.orderBy(F.rand(7)).repartition(40), ["event_type"], order, "n", 10)
    pick = lambda df: sorted((r.event_id, r.n) for r in df.select("event_id", "n").collect())
    assert pick(one) == pick(many)


def test_kept_places_are_a_longest_rising_set():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = similarity.kept_places(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got)) and [j for _, j in got] == sorted({j for _, j in got})
        nth = lambda x, k: x[:k].count(x[k])
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j] and nth(a, i) == nth(b, j)]
        best = {}
        for i, j in sorted(pairs):
            best[i, j] = 1 + max((n for (p, q), n in best.items() if p < i and q < j), default=0)
        assert len(got) == max(best.values(), default=0)


def test_line_alignment_of_blocks(spark):
    rng = random.Random(8)
    rows = [(s, k, f"{s}-{k}", rng.choice(["x", "y", "", None, "one two three", "one two four"])) for s in (1, 2, 3) for k in range(40)]
    units = spark.createDataFrame(rows, "scene_id int, sequence_index int, unit_id string, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "old_id int, new_id int")
    plain, cut = (sorted(map(tuple, drafts.align_lines(pairs, units, hot_rows=h).select("scene_pair", "new_unit_id", "old_unit_id", "same").collect()))
                  for h in (None, 7))
    assert plain == cut
    text = {r[2]: r[3] for r in rows}
    for pair, new, old in (("1|2", 2, 1), ("2|3", 3, 2)):
        same = [(int(o.split("-")[1]), int(n.split("-")[1])) for p, n, o, s in plain if p == pair and s]
        a, b = ([text[f"{s}-{k}"] for k in range(40)] for s in (old, new))
        want = similarity.kept_places([f"o{k}" if x is None else x for k, x in enumerate(a)], [f"n{k}" if x is None else x for k, x in enumerate(b)])
        assert len(same) == len(want) and [j for _, j in sorted(same)] == sorted(j for _, j in same)


def test_merges_fold_each_component_once(spark):
    rng = random.Random(2)
    chain = [(k, k, k + 1) for k in range(300)]
    rng.shuffle(chain)
    pairs = [(p, keep, gone) for p, (_, keep, gone) in enumerate(chain)]
    pairs += [(1000 + k, 5000 + rng.randrange(60), 5000 + rng.randrange(60)) for k in range(80)] + [(2000, 9000, 9001)]
    absorbed, want = {}, {}
    for p, keep, gone in sorted(pairs):
        earlier = [absorbed[x] for x in (keep, gone) if x in absorbed]
        want[p] = min(earlier, default=None)
        if not earlier:
            absorbed[gone] = p
    frame = spark.createDataFrame(pairs, "position long, keep_id long, absorb_id long")
    assert {r.position: r.skipped_by for r in merge.merge_record(frame).collect()} == want
    assert {r.position for r in merge.in_force(frame).collect()} == {p for p, by in want.items() if by is None}
    assert merge.in_force(frame.filter("1 = 0")).count() == 0
    with pytest.raises(ValueError):
        merge.roots(spark.createDataFrame([(1, 7, 8), (2, 8, 7)], "position long, keep_id long, absorb_id long"))


def test_strict_resolution_by_components_equals_one_group(spark):
    import pandas as pd
    rng = random.Random(4)
    word = lambda: rng.choice("ann bob cy dee eve".split())
    entities, aliases, mentions = [], [], []
    for script in (1, 2):
        for kind in ("cast", "prop"):
            names_ = sorted({" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(4)})
            for n in names_:
                entities.append((len(entities), script, kind, n))
                aliases += [(len(entities) - 1, word()) for _ in range(rng.randint(0, 1))]
            mentions += [(script, kind, " ".join(word() for _ in range(rng.randint(1, 3))), k, [word()] if rng.random() < .3 else []) for k in range(30)]
    e = spark.createDataFrame(entities, "entity_id long, script_id long, entity_type string, normalized_name string")
    a = spark.createDataFrame(aliases, "entity_id long, normalized_alias string")
    m = spark.createDataFrame(mentions, "script_id long, entity_type string, normalized_name string, position long, aliases array<string>")
    got = {(r.script_id, r.entity_type, r.normalized_name): (r.target_name, r.how) for r in merge.resolve_strictly(e, a, m).collect()}
    want = {}
    for script in (1, 2):
        for kind in ("cast", "prop"):
            rows = [(script, kind, -1, n, True, sorted({x for i, x in aliases if i == k})) for k, s, t, n in entities if (s, t) == (script, kind)]
            first = {}
            for s, t, n, p, al in mentions:
                if (s, t) == (script, kind):
                    at, held = first.get(n, (p, set()))
                    first[n] = at, held | set(al)
            rows += [(script, kind, p, n, False, sorted(al)) for n, (p, al) in first.items()]
            frame = pd.DataFrame(rows, columns=["script_id", "entity_type", "position", "normalized_name", "known", "aliases"])
            want |= {(script, kind, r.normalized_name): (r.target_name, r.how) for r in merge.resolve_in_order(frame).itertuples()}
    assert got == want


def test_a_verdict_looks_its_words_up_once(spark):
    """the words of a proposal are met once an item, not for each of its names and each mention."""
    from plotline.registry.verification import verdict_frames
    final, _ = verdicts.verify_assertions(*verdict_frames(Tables(spark, "/root/testdata/sf0.001")))
    plan = final._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_spoken#") and not re.search(r"array_except\([^()]*_spoken#", plan)

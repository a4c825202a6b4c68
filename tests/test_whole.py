"""Queries that ask for all rows, and the graphs they ask for by hand."""

from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from plotline.plans import views
from plotline.registry import load
from plotline.sources.tables import SCHEMAS
from tools.check import rows

FOLDER = "/root/testdata/sf0.001"


def test_every_order_has_its_graph(spark):
    entry = load()["G34_unit_graph_all"]
    got = entry.run(spark, FOLDER).toPandas()
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    want = connection.execute(entry.sql).df()
    assert rows(got) == rows(want)
    near = load()["G34_unit_graph"].run(spark, FOLDER).toPandas().set_index("request_id")
    wide = got.set_index("request_id")
    assert set(near.index) == set(wide.index)
    assert (near["links"] <= wide["links"].loc[near.index]).all() and (near["hidden"] <= wide["hidden"].loc[near.index]).all()
    assert near["links"].sum() < wide["links"].sum()


def test_unit_graph_by_hand(spark):
    facts = [(k, k % 7, f"{k % 7}-{k % 2}", 100 + k % 5 if k % 3 else None, 100 + k * k % 11, k % 10 / 10, k % 13 > 0)
             for k in range(60)]
    frame = spark.createDataFrame([(a, s, None, u, "entity" if e else "scene", "entity", e, o, c, on) for a, s, u, e, o, c, on in facts],
                                  "assertion_id long, subject_scene_id long, object_scene_id long, source_unit_id string, "
                                  "subject_kind string, object_kind string, subject_entity_id long, object_entity_id long, "
                                  "confidence double, active boolean")
    requests = spark.createDataFrame([(s, f"{s}-1", s) for s in range(9)], "request_id long, unit_id string, scene_id long")
    types = spark.createDataFrame([(100 + k, "x") for k in range(12)], "entity_id long, entity_type string")
    links, hidden = views.unit_graph(requests, frame, types, 0.6)
    live = [f for f in facts if f[6]]
    ends = {f[0]: {f[3], f[4]} - {None} for f in live}
    want, low = defaultdict(set), defaultdict(int)
    for s in range(9):
        seed = {f[0] for f in live if f[1] == s or f[2] == f"{s}-1"}
        reached = set().union(*(ends[a] for a in seed))
        for f in live:
            if f[0] in seed or ends[f[0]] & reached:
                want[s].add(f[0]) if f[5] >= 0.6 else low.__setitem__(s, low[s] + 1)
    assert sorted(map(tuple, links.select("request_id", "assertion_id").collect())) == sorted((s, a) for s in want for a in want[s])
    assert {r.request_id: r.hidden for r in hidden.collect() if r.hidden} == dict(low)


def test_pairs_of_a_hub_are_not_written(spark, monkeypatch):
    """Forty requests around one entity of two hundred edges; an id that stands for two rows is one edge with the ends of both."""
    facts = [(k, k, None, f"{k}-0", "scene", "entity", None, 7, 0.9, True) for k in range(200)]
    facts.append((0, None, None, "0-0", "entity", "entity", 8, 9, 0.1, True))
    frame = spark.createDataFrame(facts, "assertion_id long, subject_scene_id long, object_scene_id long, source_unit_id string, subject_kind string, "
                                         "object_kind string, subject_entity_id long, object_entity_id long, confidence double, active boolean")
    requests = spark.createDataFrame([(s, f"{s}-1", s) for s in range(40)], "request_id long, unit_id string, scene_id long")
    types = spark.createDataFrame([(k, "x") for k in (7, 8, 9)], "entity_id long, entity_type string")
    written, write = [], views.durable
    monkeypatch.setattr(views, "durable", lambda df: written.append(made := write(df)) or made)
    links, hidden = views.unit_graph(requests, frame, types, 0.6)
    assert links.groupBy("request_id").count().filter("count = 200").count() == 40
    assert {r.hidden for r in hidden.collect()} == {1} and max(w.count() for w in written) <= 201


def test_the_graph_of_an_order_takes_both_steps(spark):
    entry = load()["G34_unit_graph"]
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    got = entry.run(spark, FOLDER).toPandas()
    assert rows(got) == rows(connection.execute(load()["G34_unit_graph_all"].sql).df()) == rows(connection.execute(entry.sql).df())


def test_replies_are_read_once_and_never_broadcast(spark, monkeypatch):
    """One table of read items; the item joins are merged however well their sides are packed."""
    from plotline.plans import validate
    kept, durable = [], validate.durable
    monkeypatch.setattr(validate, "durable", lambda df: kept.append(df) or durable(df))
    texts = spark.createDataFrame([(1, '{"entities":[{"id":"e1","type":"prop","name":"Lamp","conf":0.9,"attrs":[{"k":"c","v":"red","unit":"u1","conf":0.9}]}'
                                       ',7],"assertions":[{"p":"requires","s":"scene","o":"e1","unit":"u1","conf":0.9}]}'),
                                   (2, " \n{\"entities\":[],\"assertions\":[]}"), (3, '[{"entities":[]}]'), (4, '{"entities":[]}'), (5, None), (6, "1,2")],
                                  "call_id long, text string")
    units = spark.createDataFrame([(1, "u1", "a red lamp")], "call_id long, unit_id string, text string")
    found = validate.validate(texts, units, spark.createDataFrame([], "call_id long, local_id string, entity_type string, name string"))
    assert sorted(r.call_id for r in found["malformed"].collect()) == [3, 4, 5, 6]
    assert sorted((r.position, r.name, r.reason) for r in found["entities"].collect()) == [(0, "Lamp", None), (1, None, "not_an_object")]
    assert [(r.key, r.reason) for r in found["attributes"].collect()] == [("c", None)]
    assert [(r.o, r.reason) for r in found["assertions"].collect()] == [("e1", None)]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in kept]
    assert sum("md5" in p for p in plans) == 1
    assert found["attributes"]._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 2


def test_a_reply_is_parsed_once_and_an_item_walked_once(spark):
    """the list around a reply is bound, and the fields of an item keep to their JSON types."""
    from pyspark.sql import functions as F

    from plotline.functions import replies
    texts = ['{"i":[{"a":"x","b":3},{"a":1,"b":"3"},{"b":2.5,"c":{}},{"a":null},[],"a",null,{}]}', '{"i":[]}]', '[{"i":[]}]', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", replies.json_object(F.col("x")).alias("r"))
    assert rows._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1
    item = rows.filter("r IS NOT NULL").select("n", F.posexplode(replies.items(F.col("r"), "$.i")).alias("pos", "item")).withColumn(
        "f", replies.fields(F.col("item"), "a", "b"))
    got = item.select("n", "pos", F.col("f").isNotNull(), replies.text(F.col("f.a")), replies.integer(F.col("f.b"))).collect()
    assert sorted(map(tuple, got)) == [(0, 0, True, "x", 3), (0, 1, True, None, None), (0, 2, True, None, None), (0, 3, True, None, None),
                                       (0, 4, False, None, None), (0, 5, False, None, None), (0, 6, False, None, None), (0, 7, True, None, None)]
    same = item.filter((replies.is_object(F.col("item")) != F.col("f").isNotNull()) | ~replies.text_at(F.col("item"), "$.a").eqNullSafe(
        replies.text(F.col("f.a"))))
    assert same.count() == 0


def test_endpoints_meet_a_name_once(spark):
    """What meets an edge is one row a name, not every entity of that name."""
    from plotline.plans import verdicts
    edges = spark.createDataFrame([(1, "s", "uses", "object", "lamp"), (2, "s", "uses", "object", "lamp"), (2, "s", "uses", "object", "lamp"),
                                   (3, "s", "uses", "object", "none"), (4, "s", "nothing", "object", "lamp")],
                                  "batch_id long, script_id string, predicate string, side string, local_name string")
    declared = spark.createDataFrame([(2, "lamp", "vfx"), (2, "lamp", "prop")], "batch_id long, normalized_name string, entity_type string")
    entities = spark.createDataFrame([("s", "lamp", 100 + i, "prop") for i in range(50)] + [("s", "lamp", 7, "location"), ("s", "lamp", 3, "odd")],
                                     "script_id string, normalized_name string, entity_id long, entity_type string")
    found = verdicts.new_endpoints(edges, declared, entities)
    assert sorted((r.batch_id, r.new_type, r.entity_id, r.entity_type) for r in found.collect()) == [
        (1, None, 100, "prop"), (2, "vfx", None, "vfx"), (3, None, None, None), (4, None, None, None)]
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in joined and joined.index("Join LeftOuter") < joined.index("collect_list")


def test_findings_are_read_once(spark, monkeypatch, tmp_path):
    """No filter repeats the reading of a reply."""
    from plotline.plans import validate
    kept, durable = [], validate.durable
    monkeypatch.setattr(validate, "durable", lambda df: kept.append(df) or durable(df))
    spark.createDataFrame([(1, '{"findings":[{"message":"m","severity":"low","evidence_ids":["a"]}]}'), (2, "[]")], "call_id long, text string").write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t")
    found, bad = validate.continuity(texts, texts.select("call_id", F.lit("a").alias("assertion_id")))
    assert [(r.call_id, r.reason) for r in found.collect()] == [(1, None)] and [r.call_id for r in bad.collect()] == [2]
    lines = kept[0]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("md5" in x for x in lines) and not any("Filter" in x and "md5" in x for x in lines)

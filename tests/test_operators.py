"""Operators on small tables worked out by hand or by brute force."""

import json
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.functions import expressions as X
from storyloom.functions import text as T
from storyloom.operators import assess, candidates, causal, context, coreference, ordering, parsing, scenes, similarity, themes
from storyloom.plans.stages import Checkpoints
from storyloom.plans.story import Assessors, story_graph
from storyloom.plans.story import candidate_pools as candidates_of
from storyloom.sinks import writers
from storyloom.sources import readers


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ranks_look_ahead_and_fill_over_blocks(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "at long, key string, v long").repartition(5)
    ranks = ordering.ranked(df, ["key"], ["at"], F.floor(F.col("at") / 7), "r")
    seen = {}
    want = [(a, k, v, seen.setdefault(k, []).append(a) or len(seen[k]) - 1) for a, k, v in rows]
    assert tuples(ranks) == sorted(want, key=repr)
    near = ordering.ahead(ranks, ["key"], "r", "at", range(1, 4), "next", size=8)
    for r in near.collect():
        after = seen[r.key][r.r + 1 : r.r + 4]
        assert [x for x in r.next if x is not None] == after
    last, want = None, []
    for a, _, v in rows:
        last = v if v is not None else last
        want.append((a, last))
    assert tuples(ordering.filled(df, "at", ["v"], size=16).select("at", "v_filled")) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(i, i, c) for i, c in enumerate([1, 1, 2, 2, 2])], "id long, seq long, chapter long")


def test_local_pools(spark, five):
    assert tuples(candidates.adjacent_pairs(five)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert tuples(candidates.window_pairs(five)) == [(0, 2), (0, 3), (1, 3), (1, 4), (2, 4)]
    assert tuples(ordering.follows(five)) == [(0, 1), (2, 3), (3, 4)]
    assert tuples(candidates.chapter_transition_pairs(five)) == [(a, b) for a in (0, 1) for b in (2, 3, 4)]
    occ = spark.createDataFrame([("actor:x", 0, 0), ("actor:x", 0, 0), ("actor:x", 3, 3), ("place:y", 1, 1), ("place:y", 2, 2)], "key string, id long, seq long")
    assert tuples(candidates.entity_pairs(occ)) == [(0, 0), (0, 3)]
    assert candidates.entity_broad_pairs(occ).count() == 0
    assert [candidates.temporal_reach(n, m) for n, m in ((100, 5000), (100, 25_000), (20_000, 25_000))] == [50, 200, 100]
    pools = candidates.pooled({"adjacent": candidates.adjacent_pairs(five), "window": candidates.window_pairs(five)})
    capped = candidates.priority_cap(candidates.with_gap(pools, five), ["adjacent", "window"], 3)
    assert [(r.src, r.dst, r.priority) for r in capped.collect()] == [(0, 2, 4), (1, 3, 4), (2, 4, 4)]


def test_peaks_take_the_first_of_a_tie(spark):
    rows = spark.createDataFrame([(i, i, 0.5 if i % 2 else 0.9, ["a"], [], []) for i in range(40)], "id long, seq long, confidence double, actors array<string>, patients array<string>, reasons array<string>")
    assert sorted(r.id for r in candidates.peak_events(rows).collect()) == [2 * i for i in range(10)]
    assert candidates.peak_events(rows.limit(0)).count() == 0


def test_long_shots_need_more_than_two_windows(spark):
    rows = [(i, i, "s", [1.0, float(i % 3)]) for i in range(230)]
    df = spark.createDataFrame(rows, "id long, seq long, scene string, vec array<double>")
    got = {(r.src, r.dst) for r in similarity.longshot_pairs(df, 0.99).collect()}
    assert got == {(i, j) for i in range(100) for j in range(130, 230) if i % 3 == j % 3}
    assert similarity.longshot_pairs(df.filter("seq < 200"), 0.99).count() == 0
    few = similarity.semantic_topk_pairs(df, 0.99, top=2).filter("dst = 50").collect()
    assert sorted(r.src for r in few) == [2, 5]


def test_top_pairs_reach_every_event(spark):
    x = np.random.default_rng(7).normal(size=(10_050, 16))
    x[10_040] = x[3]
    df = spark.createDataFrame([(i, i, v) for i, v in enumerate(x.tolist())], "id long, seq long, vec array<double>")
    assert (3, 10_040) in {(r.src, r.dst) for r in similarity.semantic_topk_pairs(df, 0.9999).collect()}


def test_inheritance(spark):
    ev = spark.createDataFrame([(i, i) for i in range(5)], "id long, seq long")
    pr = spark.createDataFrame([(1, 0, "Ann", "actor", 0.9), (1, 1, "ann", "patient", 0.8), (3, 0, "hope", "whyfactor", 0.7)], "event_id long, ord long, entity_name string, entity_type string, strength double")
    assert tuples(context.propagate_actors(ev, pr).select("event_id", "entity_name", "entity_type", "strength")) == [(i, "ann", "patient", 0.5) for i in (2, 3, 4)]
    assert tuples(context.propagate_reasons(ev, pr).select("event_id", "entity_name", "strength")) == [(4, "hope", 0.7)]


def test_admission(spark, five):
    rows = [(0, 1, "Truby", "REVELATION"), (0, 1, "@mckee", "enables"), (1, 0, "mckee", "ENABLES"), (2, 2, "mckee", "ENABLES"), (2, 9, "mckee", "ENABLES"), (2, 3, "mckee", "REVELATION"), (3, 4, "mckee", None), (3, 4, "mckee", "none"), (1, 2, "truby", "revelation")]
    df = spark.createDataFrame([(*r, 0.5, 0) for r in rows], "src long, dst long, theory string, relation string, confidence double, ord int")
    links = causal.admit(causal.valid_assessments(df, causal.relation_types(spark)), five)
    assert tuples(links.select("src", "dst", "relation", "theory")) == [(0, 1, "ENABLES", "@McKee"), (1, 2, "REVELATION", "@Truby")]
    assert tuples(causal.dag_stats(links, five)) == [(5, 2, 1, 1, 0.4)]
    assert causal.backward_edges(links).first().backward == 0 and not causal.has_cycle(links)
    assert causal.has_cycle(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src long, dst long"))


def test_scenes_and_bridge(spark, five):
    proposed = spark.createDataFrame([("a", 1, 1, [0, 2]), ("b", 2, 2, [2, 3, 3]), ("c", 3, 2, [3, 77]), ("d", 4, 1, [4])], "scene string, scene_ord long, chapter long, ids array<long>")
    member = scenes.members(scenes.listed(proposed), five)
    assert tuples(member.select("scene", "id")) == [("a", 0), ("b", 2), ("b", 3), ("c", 3)]
    assert tuples(scenes.last_scene(member)) == [(0, "a"), (2, "b"), (3, "c")]
    assert [(r.chapter, r.n_events) for r in scenes.orphan_scenes(five, member).orderBy("chapter").collect()] == [(1, 1), (2, 1)]
    notes = spark.createDataFrame([(0, "POWER", "DIRECT", "bogus", "0.5"), (1, "POWER", "what", "enabling", "x"), (2, "POWER", "none", None, None), (1, "GREED", "direct", None, None)], "id long, theme string, involvement string, role string, confidence string")
    clean = themes.cleaned(notes)
    links = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert tuples(themes.bridged(clean, links)) == [(0, "POWER", "direct", None, 0.5), (1, "POWER", "indirect", "mediating", None), (2, "POWER", "none", None, None)]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_names(spark):
    got = lambda n, **k: one(spark, X.is_character(F.lit(n), **k))
    for name in ("", "x", "He", "his sister", "the man", "everyone", "I"):
        assert not got(name), name
    assert got("Herbert") and not got("Herbert", legacy_prefix=True) and got("The Captain") and got("Ms. Havisham")
    for name, want in (("Pip (Child)", "Pip"), ("Young Pip", "Pip"), ("Mr. Jaggers", "Jaggers"), ("Sir", "Sir"), ("Little Old Dr. No (x)", "Little Old Dr. No")):
        normal = one(spark, X.normalized_name(F.lit(name)))
        assert normal == (want if not name.startswith("Little") else "Old Dr. No"), name
        assert coreference.valid_name(name) == got(name)


def test_registry():
    r = coreference.Registry()
    stream = ["philip", "Philip Pirrip", "Pirrip", "philip", "Mr. Joe Gargery", "Joe", "the man", "a very long descriptive mention", "Estella", None, "Gargery of the forge"]
    assert [r.resolve(x) for x in stream] == [None, "Philip Pirrip", "Philip Pirrip", "Philip Pirrip", "Mr. Joe Gargery", "Mr. Joe Gargery", None, None, "Estella", None, "Mr. Joe Gargery"]
    assert coreference.batch_resolve(["Joe", "Joe", "Estella"], r) == ["Mr. Joe Gargery", "Estella"]


def test_coreference_per_book(spark):
    rows = [(b, i, 0, n) for b in (1, 2) for i, n in enumerate(["Joe Gargery", "Joe"])]
    out = coreference.resolve_characters(spark.createDataFrame(rows, "book long, seq long, ord long, name string"))
    assert {r.canonical for r in out.collect()} == {"Joe Gargery"}


def test_expressions(spark):
    assert one(spark, X.calibrated(F.lit(0.9), F.lit(True), F.lit(True))) == 0.94
    assert one(spark, X.calibrated(F.lit(0.9), F.lit(False), F.lit(False))) == 0.82
    assert one(spark, X.truncate_safe(F.lit("ab\\\\cd"), 4)) == "ab"
    assert one(spark, X.canonical_uid(F.lit("whyfactor"), F.lit('"' * 5 + "x y" * 20))) == "whyfactor_" + ("x_y" * 20)[:30]
    assert one(spark, X.sanitized(F.lit(""))) == "unknown"
    assert one(spark, X.normalized_weights(F.array(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0)))) == [0.5, 0.5]
    assert one(spark, X.theory(F.lit("TRUBY"))) == "@Truby"
    assert one(spark, X.cypher_value(F.lit('a"b\\c\n'))) == '"a\\"b\\\\c\\n"'
    assert [one(spark, X.cypher_name(F.lit(n))) for n in ("Event", "order", "a-b", "1x", "x`y")] == ["Event", "`order`", "`a-b`", "`1x`", "`x``y`"]
    assert one(spark, X.supertype(F.lit("enables"))) == "CAUSAL_PRODUCTION" and one(spark, X.supertype(F.lit("nope"))) is None
    assert sum(map(len, X.V.SUPERTYPES.values())) == 84


def test_chapters(spark):
    text = "Title\nCHAPTER I\nfirst\n\nmore\nCHAPTER II.\n \nCHAPTER III\nthird"
    assert [(c.number, c.body) for c in one(spark, T.chapters(F.lit(text)))] == [(1, "first\n\nmore"), (3, "third")]
    assert [(c.number, c.body) for c in one(spark, T.chapters(F.lit("a\n\n \n\nb")))] == [(1, "a"), (2, "b")]
    assert one(spark, T.chapters(F.lit(None).cast("string"))) is None
    assert one(spark, T.sentences(F.lit("One. Two!  three"))) == ["One. ", "Two! ", "three. "]


def test_folds():
    assert T.pack_sentences(["aa ", "bb ", "cc ", "dd "], 9) == ["aa bb cc ", "bb cc dd "]
    assert T.pack_sentences(["x" * 20, "y"], 9) == ["x" * 20, "y"]
    text = "a" * 400
    assert T.split_passages(text) == ["a" * 400, "a" * 80]
    marked = "b" * 450 + "!" + "c" * 30 + "." + "d" * 200
    assert T.split_passages(marked)[0] == marked[:482]
    assert T.split_paragraphs("short\n\n" + "s" * 60 + "\n\n" + "Long sentence here. " * 60)[0] == "s" * 60
    assert all(len(p) <= 640 for p in T.split_paragraphs("Long sentence here. " * 60))


@given(st.lists(st.text("ab", min_size=1, max_size=12), max_size=20), st.integers(1, 30))
def test_chunks_hold_every_sentence(parts, size):
    out = T.pack_sentences(parts, size, carried=0)
    assert "".join(out) == "".join(parts) and all(len(c) <= size or c in parts for c in out)


def test_parsing(spark):
    answers = [
        (1, 0, '```json\n{"events":[{"raw_description":"a","event_category":"travel","actors":"Pip","confidence":0.9,"location_context":""}]}\n```'),
        (1, 1, '[{"raw_description":"b","action_type":"weird","actors":["Joe","x"],"why_factors":["hope"],"location_context":"forge"}]'),
        (2, 0, "no json"), (2, 1, None), (2, 2, '{"events":[]}'),
    ]
    df = spark.createDataFrame(answers, "chapter int, chunk int, answer string")
    ev = parsing.parse_events(df).withColumn("id", F.col("seq"))
    assert [(r.seq, r.description, r.action_type, r.actors, r.confidence) for r in ev.orderBy("seq").collect()] == [(0, "a", "TRAVEL", ["Pip"], 0.9), (1, "b", "PHYSICAL_ACTION", ["Joe", "x"], 0.82)]
    assert {(r.entity_name, r.entity_type) for r in parsing.productions_of(ev).collect()} == {("Pip", "actor"), ("Joe", "actor"), ("hope", "whyfactor"), ("forge", "place")}
    rates = {r.chapter: (r.failed, r.flagged) for r in parsing.chunk_failures(df.select("chapter", "answer")).collect()}
    assert rates == {1: (0, False), 2: (3, True)}


def test_assessors(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "id long")
    calls = assess.Batched(lambda part: pd.DataFrame({"twice": part["id"] * 2}), "twice long", size=3)
    assert tuples(calls.assess(df)) == [(i, 2 * i) for i in range(7)]

    def broken(part):
        raise OSError("no network")

    assert {r.twice for r in assess.Batched(broken, "twice long", wait=lambda n, limited: 0).assess(df).collect()} == {None}
    told = assess.Batched(broken, "twice long", size=4, tries=2, wait=lambda n, limited: 0, report=True).assess(df)
    assert {(r.status, r.error) for r in told.collect()} == {("failed", "OSError: no network")}
    assert tuple(assess.failures(told).first()) == (7, 7, 1.0, "OSError: no network")
    good = assess.Batched(lambda part: pd.DataFrame({"twice": part["id"] * 2}), "twice long", report=True).assess(df)
    assert tuple(assess.failures(good).first()) == (7, 0, 0.0, None)
    assert [assess.backoff(n, False) for n in range(4)] == [1, 2, 4, 8] and [assess.backoff(n, True) for n in range(3)] == [30, 45, 60]

    def limited(part):
        raise assess.RateLimited("slow down")

    with pytest.raises(Exception, match="slow down"):
        assess.Batched(limited, "twice long", tries=2, wait=lambda n, limited: 0).assess(df).collect()
    cache = spark.createDataFrame([], "key string, twice long")
    rule = assess.RuleBased(twice=F.col("id") * 2)
    answered, fresh = assess.cached(df, cache, rule, "m", ["id"], ["twice"])
    assert answered.count() == 7 and fresh.count() == 7
    assert assess.cached(df, fresh, rule, "m", ["id"], ["twice"])[1].count() == 0


def test_sources(spark, tmp_path):
    assert readers.parse_ontology('{"event_types": ["A"]}\n{"RelationTypeDictionary_Truby": [{"name": "R", "theory": "@Truby"}]}').relations == {"R": ("@Truby", "uni")}
    assert readers.parse_ontology("{broken").events == readers.default_ontology().events
    (tmp_path / "s.cypher").write_text("// head\nCREATE CONSTRAINT x;\nRETURN 1;\nMATCH (n)\nSET n.a = 1;\n")
    assert [r.statement for r in readers.read_cypher(spark, str(tmp_path / "s.cypher")).collect()] == ["MATCH (n)\nSET n.a = 1"]
    (tmp_path / "t.csv").write_text(':ID,Name\n1,"a, b"\n')
    assert tuples(readers.read_csv(spark, str(tmp_path / "t.csv"), {"id": ["ID", ":ID"], "label": ["label", "name"], "none": ["zz"]})) == [("1", "a, b", None)]
    (tmp_path / "b.txt").write_text("x\ny")
    assert readers.read_text(spark, str(tmp_path / "*.txt")).first().text == "x\ny"


def test_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    store = Checkpoints(spark, str(tmp_path), "run", {"pairs": 3})
    assert store.load("linking") is None
    store.save("linking", df, "links")
    assert tuples(store.load("linking")) == tuples(df) and store.last() == "linking" and len(store.summary()) == 1
    assert Checkpoints(spark, str(tmp_path), "run", {"pairs": 4}).load("linking") is None
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "run" / "linking"))
    assert store.load("linking") is None
    store.clear("linking")
    assert store.list() == []
    store.clear_all()


def test_whole_run(spark, tmp_path):
    text = "CHAPTER I\nPip met Joe. He ran! They ate.\nCHAPTER II\nThe end came."
    event = lambda who: F.concat(F.lit('{"events":[{"raw_description":"'), F.substr("text", F.lit(1), F.lit(9)), F.lit(f'","actors":["{who}","Joe"],"event_category":"TRAVEL"}},{{"raw_description":"then"}}]}}'))
    ask = Assessors(
        assess.RuleBased(answer=event("Pip")), assess.RuleBased(scene=F.when(F.col("seq") == 0, "scene/one")),
        assess.RuleBased(relation=F.lit("enables"), theory=F.lit("mckee"), mechanism=F.lit("m"), weight=F.lit(0.5), confidence=F.lit(0.7), ord=F.lit(0)),
        assess.RuleBased(involvement=F.when(F.col("theme") == "POWER", "direct"), role=F.lit(None).cast("string"), confidence=F.lit("0.5")),
    )
    vec = F.array(F.char_length("text").cast("double"), F.lit(1.0))
    ask.agents, ask.vectors = assess.RuleBased(agent_type=F.when(F.col("name") == "Pip", "PROTAGONIST_HERO")), assess.RuleBased(vec=vec)
    asked = []
    rule = ask.pairs
    ask.pairs = type("Spy", (), {"assess": lambda self, rows: (asked.append(rows), rule.assess(rows))[1]})()
    store = Checkpoints(spark, str(tmp_path / "ck"), "book", {})
    out = story_graph(spark.createDataFrame([(text,)], "text string"), ask, store)
    assert out["events"].count() == 4 and out["follows"].count() == 2 and out["links"].count() == 6
    assert {r.scene for r in out["members"].collect()} == {"scene/one", "scene/1/rest", "scene/2/rest"}
    assert {r.label for r in out["nodes"].collect()} == {"Event", "Agent", "Scene"}
    assert len(store.list()) == 7
    assert {r.name: r.agent_type for r in out["agents"].collect()} == {"Pip": "PROTAGONIST_HERO", "Joe": "STRUCTURAL_AGENT"}
    pairs = asked[0].collect()
    assert all(r.src_text and r.dst_text for r in pairs) and len(pairs) == 6
    again = story_graph(spark.createDataFrame([(text,)], "text string"), ask, store)
    assert again["edges"].count() == out["edges"].count()
    events = out["events"].withColumns({"name": F.col("description"), "scene": F.lit(""), "notes": F.lit(None).cast("string")})
    links = out["links"]
    table = out["rollup"].select("scene", F.lit("t").alias("theme"), "chapter", F.lit(0.5).alias("confidence"))
    tables = writers.csv_tables(events, out["productions"], links, out["members"], table, out["follows"])
    assert len(tables) == 12
    writers.write_csv_tables(tables, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv" / "causes.csv"), header=True)
    assert back.columns == [":START_ID", ":END_ID", ":TYPE", "relationType", "mechanism", "weight", "confidence", "edge_supertype"] and back.count() == 6
    assert spark.read.csv(str(tmp_path / "csv" / "hosts.csv"), header=True).count() == 0
    nodes = writers.node_statements(out["nodes"], {"name": "string"})
    edges = writers.edge_statements(out["edges"], {})
    writers.write_cypher(nodes, edges, str(tmp_path / "cypher"))
    assert readers.read_cypher(spark, str(tmp_path / "cypher" / "1-nodes")).count() == out["nodes"].count()
    records = writers.jsonld_links(links).unionByName(writers.jsonld_events(out["events"]))
    assert len(json.loads(writers.graph_document(records))["@graph"]) == 10
    assert re.search(r"\[r:ENABLES\]", "".join(r.statement for r in edges.collect()))


def test_a_dead_model_stops_the_run(spark, tmp_path):
    def dead(part):
        raise OSError("no network")

    none = assess.RuleBased()
    ask = Assessors(assess.Batched(dead, "answer string", tries=1, report=True), none, none, none)
    with pytest.raises(RuntimeError, match="1 of 1 chunks have no answer: OSError: no network"):
        story_graph(spark.createDataFrame([("CHAPTER I\nOne. Two.",)], "text string"), ask, Checkpoints(spark, str(tmp_path), "book", {}))


def test_pools_of_a_run(spark):
    rows = [(i, i, i // 6, f"word{i % 4} same text") for i in range(18)]
    order = spark.createDataFrame(rows, "id long, seq long, chapter int, text string")
    none, member = spark.createDataFrame([], "key string, id long, seq long"), order.select(F.col("chapter").cast("string").alias("scene"), "id")
    plain = candidates_of(order, none, member, None, 0.5)
    assert set(plain) == {"adjacent", "window", "entity", "bm25", "proximity"}
    far = order.select("id", "seq", F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double"))).alias("vec"))
    assert "proximity" in candidates_of(order, none, member, far, 1.1)
    near = candidates_of(order, none, member, far, 0.5)
    assert {"scene", "longshot"} < set(near) and "proximity" not in near
    got, angle = set(tuples(near["scene"])), lambda a, b: math.cos(a - b)
    assert got == {(a, b) for a in range(18) for b in range(a + 1, 18) if a // 6 == b // 6 and angle(a, b) >= 0.5}


def test_streams(spark, sf, tmp_path):
    from storyloom.streaming import events as S

    source = spark.read.parquet(f"{sf}/events.parquet")
    source.repartition(1).sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "in"))
    stream = S.read_events(spark, str(tmp_path / "in"), source.schema)
    for name, df, mode in (("counts", S.windowed_counts(stream), "complete"), ("pairs", S.entity_pairs(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("counts").agg(F.sum("events")).first()[0] == source.count()
    assert spark.table("pairs").count() == source.count() - source.select("user_id").distinct().count()

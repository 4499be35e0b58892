"""Registered queries of the event-graph operators, each over whole tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folds_sql as S
from .functions import expressions as X
from .functions import text as T
from .functions import vocabulary as V
from .operators import assess, bm25, candidates, causal, context, coreference, graph, parsing, prompts, scenes, similarity, themes, tools
from .operators.assess import bulk_size
from .operators.ordering import follows
from .plans import tables as D
from .plans.story import run_stats
from .runtime import materialize
from .sinks import writers as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SIMILAR, MAX_PAIRS, TIER_PAIRS = 0.3, 25_000, 2_000


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_PAIRS = "SELECT src, dst FROM adj UNION SELECT src, dst FROM win UNION SELECT src, dst FROM ent"
_KNOWN = " OR ".join(f"(relation IN ({', '.join(repr(r) for r in rs)}) AND theory = '{t}')" for t, rs in V.RELATION_TYPES.items())
_COS = "list_dot_product(a.v, b.v) / (greatest(a.n, 1e-9) * greatest(b.n, 1e-9))"
#: Common table expressions by name; later ones use earlier ones.
CTE = {
    "ev": """SELECT event_id AS id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
        CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS chapter, user_id, event_type, value,
        json_extract_string(props, '$.k') AS k,
        CASE WHEN event_type = 'error' THEN '' WHEN event_type <> 'view' THEN event_type END AS location,
        CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 <> 1 THEN 'h' || hour(ts) END AS time FROM events""",
    "tn": """SELECT seq AS id, *, round((length(text) % 100) / 100, 2) AS confidence FROM (
        SELECT CAST(row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS BIGINT) AS seq, conv_id AS chapter, turn, role, text FROM conversations)""",
    "ve": """SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id AS id,
        CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS seq, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    "adj": "SELECT * FROM (SELECT id AS src, lead(id) OVER (ORDER BY seq) AS dst FROM ev) WHERE dst IS NOT NULL",
    "win": "SELECT a.id AS src, b.id AS dst FROM ev a JOIN (SELECT unnest([2, 3]) AS o) ON true JOIN ev b ON b.seq = a.seq + o",
    "ent": "SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY user_id ORDER BY seq) AS dst FROM ev) WHERE dst IS NOT NULL",
    "sce": f"SELECT a.id AS src, b.id AS dst, {_COS} AS score FROM ve a JOIN ve b ON a.label = b.label AND a.seq < b.seq WHERE {_COS} >= {SIMILAR}",
    "lng": f"""SELECT DISTINCT a.id AS src, b.id AS dst, {_COS} AS score FROM (SELECT count(*) AS c FROM ve) z
        JOIN (SELECT unnest(range(100000)) AS k) ON 50 * k + 100 < z.c - 50 * k - 100
        JOIN ve a ON a.seq >= 50 * k AND a.seq < 50 * k + 100 JOIN ve b ON b.seq >= z.c - 50 * k - 100 AND b.seq < z.c - 50 * k WHERE {_COS} >= {SIMILAR}""",
    "pools": """SELECT src, dst, CAST(bit_or(b) AS INTEGER) AS pools FROM (SELECT src, dst, 1 AS b FROM adj UNION ALL SELECT src, dst, 2 FROM win
        UNION ALL SELECT src, dst, 4 FROM ent UNION ALL SELECT src, dst, 8 FROM sce UNION ALL SELECT src, dst, 16 FROM lng) GROUP BY src, dst""",
    "pr": """SELECT id AS event_id, seq AS event_seq, CAST(0 AS BIGINT) AS ord, 'U' || user_id AS entity_name, 'actor' AS entity_type, CAST(0.9 AS DOUBLE) AS strength FROM ev WHERE id % 3 <> 0
        UNION ALL SELECT id, seq, 1, CASE WHEN id % 2 = 0 THEN 'u' || user_id ELSE 'V' || (user_id % 10) END, 'patient', 0.8 FROM ev WHERE id % 5 = 0
        UNION ALL SELECT id, seq, 2, event_type || ' "urge": ' || (user_id % 3), 'whyfactor', 0.7 FROM ev WHERE id % 4 = 1
        UNION ALL SELECT id, seq, 3, 'k' || k, 'whyfactor', 0.6 FROM ev WHERE id % 8 = 1""",
    "asd": f"""SELECT src, dst, theory, upper(trim(relation)) AS relation, round(((src + dst) % 100) / 100, 2) AS confidence FROM (
        SELECT src, dst, '@McKee' AS theory, {_list(D.MCKEE)}[1 + (src * 7 + dst * 13) % 11] AS relation FROM ({_PAIRS})
        UNION ALL SELECT src, dst, '@Truby', {_list(D.TRUBY)}[1 + (src * 5 + dst * 3) % 7] FROM ({_PAIRS}))""",
    "ok": f"SELECT * FROM asd WHERE relation NOT IN ('NONE', 'NULL', '') AND ({_KNOWN})",
    "lk": """SELECT * FROM (SELECT o.*, a.seq AS src_seq, b.seq AS dst_seq, row_number() OVER (PARTITION BY src, dst ORDER BY theory) AS rn
        FROM ok o JOIN ev a ON a.id = o.src JOIN ev b ON b.id = o.dst WHERE a.seq < b.seq) WHERE rn = 1""",
    "mb": """SELECT DISTINCT p.scene, CAST(p.scene_ord AS BIGINT) AS scene_ord, p.chapter, p.id FROM (
        SELECT 'scene/' || chapter || '/' || (user_id % 3) AS scene, chapter * 10 + user_id % 3 AS scene_ord, chapter, id FROM ev WHERE id % 6 <> 0
        UNION ALL SELECT 'scene/' || chapter || '/x', chapter * 10 + 9, chapter, id FROM ev WHERE id % 10 = 0
        UNION ALL SELECT 'scene/' || (chapter + 1) || '/x', (chapter + 1) * 10 + 9, chapter + 1, id FROM ev WHERE id % 50 = 0) p
        JOIN ev ON ev.id = p.id AND ev.chapter = p.chapter""",
    "fl": """SELECT id, seq, chapter, coalesce(last_value(nullif(location, '') IGNORE NULLS) OVER w, location) AS location,
        coalesce(last_value(nullif(time, '') IGNORE NULLS) OVER w, time) AS time FROM ev WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "nt": f"""SELECT id, theme, involvement, CASE WHEN involvement <> 'none' AND role IN ({', '.join(repr(r) for r in V.ROLES)}) THEN role END AS role, confidence FROM (
        SELECT id, theme, CASE WHEN lower(inv) IN ('direct', 'indirect', 'latent', 'none') THEN lower(inv) ELSE 'none' END AS involvement, role, confidence FROM (
        SELECT id, t.theme, {_list(D.INVOLVED)}[1 + (id + 3 * t.n) % {len(D.INVOLVED)}] AS inv, {_list(D.ROLE)}[1 + (id * 5 + t.n) % {len(D.ROLE)}] AS role,
        try_cast({_list(D.CONFIDENCE)}[1 + (id + t.n) % 3] AS DOUBLE) AS confidence FROM ev,
        (SELECT unnest({_list(V.THEMES)}) AS theme, unnest(range({len(V.THEMES)})) AS n) t))""",
    "nb": """SELECT n.id, n.theme, CASE WHEN n.involvement = 'none' AND d.id IS NOT NULL THEN 'indirect' ELSE n.involvement END AS involvement,
        CASE WHEN n.involvement = 'none' AND d.id IS NOT NULL THEN 'mediating' ELSE n.role END AS role, confidence FROM nt n LEFT JOIN (
        SELECT DISTINCT e.a AS id, m.theme FROM (SELECT src AS a, dst AS b FROM lk UNION ALL SELECT dst, src FROM lk) e
        JOIN nt m ON m.id = e.b AND m.involvement = 'direct') d ON d.id = n.id AND d.theme = n.theme""",
    "uid": r"""SELECT *, CASE WHEN entity_type IN ('actor', 'patient') THEN 'agent_' || clean WHEN entity_type = 'whyfactor' THEN 'whyfactor_' || left(clean, 30)
        ELSE entity_type || '_' || clean END AS uid FROM (SELECT *, replace(replace(replace(replace(replace(lower(entity_name), ' ', '_'), '"', ''), '''', ''), ':', ''), '\', '') AS clean FROM pr)""",
    "en": """SELECT uid, CASE WHEN entity_type = 'whyfactor' THEN 'WhyFactor' ELSE 'Agent' END AS label, entity_name AS name, entity_type FROM (
        SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE entity_type WHEN 'actor' THEN 0 WHEN 'patient' THEN 1 ELSE 2 END, event_seq, ord, entity_name) AS rn FROM uid) WHERE rn = 1""",
    "ru": """SELECT m.scene, m.chapter, count(*) AS n_events, min(nullif(e.location, '')) AS location, min(nullif(e.time, '')) AS time FROM mb m JOIN fl e ON e.id = m.id GROUP BY m.scene, m.chapter""",
    "pa": "SELECT DISTINCT m.scene, p.entity_type, p.entity_name FROM mb m JOIN pr p ON p.event_id = m.id",
}
_CTE_NEEDS = {
    "adj": ["ev"], "win": ["ev"], "ent": ["ev"], "sce": ["ve"], "lng": ["ve"], "pools": ["adj", "win", "ent", "sce", "lng"], "pr": ["ev"],
    "asd": ["adj", "win", "ent"], "ok": ["asd"], "lk": ["ok", "ev"], "mb": ["ev"], "fl": ["ev"], "nt": ["ev"], "nb": ["nt", "lk"], "uid": ["pr"],
    "en": ["uid"], "ru": ["mb", "fl"], "pa": ["mb", "pr"],
}


def with_ctes(body: str, *names: str) -> str:
    found: list[str] = []

    def add(n: str) -> None:
        for m in _CTE_NEEDS.get(n, []):
            add(m)
        if n not in found:
            found.append(n)

    for n in names:
        add(n)
    return (f"WITH {', '.join(f'{n} AS ({CTE[n]})' for n in found)} " if found else "") + body


def query(sql: str | None = None, *ctes: str):
    """Register a function as the query of its name, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_ctes(sql, *ctes)
        return f

    return register


def _n_events(spark, sf) -> int:
    return D.load(spark, sf, "events").count()


# --- candidate pools ---


@query("SELECT src, dst FROM adj", "adj")
def adjacent_pairs(spark, sf):
    return candidates.adjacent_pairs(D.order(spark, sf))


@query("SELECT src, dst FROM win", "win")
def window_pairs(spark, sf):
    return candidates.window_pairs(D.order(spark, sf))


@query("SELECT DISTINCT src, dst FROM ent", "ent")
def entity_consecutive_pairs(spark, sf):
    return candidates.entity_pairs(D.occurrences(D.order(spark, sf), "user_id"))


@query("""SELECT DISTINCT a.id AS src, b.id AS dst FROM o a JOIN o b ON a.user_id = b.user_id AND b.r BETWEEN a.r + 1 AND a.r + 4 WHERE a.c > 5""".replace("FROM o a", "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq, id) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM ev) a").replace("JOIN o b", "JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq, id) AS r FROM ev) b"), "ev")
def entity_broad_pairs(spark, sf):
    return candidates.entity_broad_pairs(D.occurrences(D.order(spark, sf), "user_id"))


@query("SELECT a.id AS src, b.id AS dst FROM tn a JOIN tn b ON b.seq - a.seq BETWEEN 1 AND 50 WHERE b.seq - a.seq < 20 OR a.chapter = b.chapter", "tn")
def temporal_window_pairs(spark, sf):
    return candidates.temporal_window_pairs(D.turns(spark, sf))


@query("""SELECT a.id AS src, b.id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq DESC) AS r, dense_rank() OVER (ORDER BY chapter) AS c FROM ev) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq) AS r, dense_rank() OVER (ORDER BY chapter) AS c FROM ev) b ON b.c = a.c + 1 WHERE a.r <= 5 AND b.r <= 5""", "ev")
def chapter_transition_pairs(spark, sf):
    return candidates.chapter_transition_pairs(D.order(spark, sf))


@query("""SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst FROM tn a JOIN tn b ON b.seq BETWEEN a.seq + 1 AND a.seq + 5
    UNION SELECT a.id, b.id FROM tn a JOIN tn b ON a.chapter = b.chapter AND b.seq BETWEEN a.seq + 1 AND a.seq + 5)""", "tn")
def proximity_pairs(spark, sf):
    rows = D.turns(spark, sf)
    return candidates.proximity_pairs(rows, rows.select(F.col("chapter").alias("scene"), "id", "seq"))


@query("SELECT src, dst, round(score, 6) AS score FROM sce", "sce")
def scene_similarity_pairs(spark, sf):
    return similarity.scene_pairs(D.vectors(spark, sf), SIMILAR).withColumn("score", F.round("score", 6))


@query("SELECT src, dst, round(max(score), 6) AS score FROM lng GROUP BY src, dst", "lng")
def longshot_pairs(spark, sf):
    return similarity.longshot_pairs(D.vectors(spark, sf), SIMILAR).withColumn("score", F.round("score", 6))


@query(f"""SELECT src, dst, round(score, 6) AS score FROM (SELECT a.id AS src, b.id AS dst, {_COS} AS score, row_number() OVER (PARTITION BY b.id ORDER BY {_COS} DESC, a.seq) AS r
    FROM ve a JOIN ve b ON b.seq - a.seq > 5 WHERE {_COS} >= {SIMILAR}) WHERE r <= 10""", "ve")
def semantic_topk_pairs(spark, sf):
    return similarity.semantic_topk_pairs(D.vectors(spark, sf), SIMILAR).withColumn("score", F.round("score", 6))


_PEAKS = """(SELECT *, round(confidence + 0.1 + CASE WHEN seq % 3 = 0 THEN 0.2 ELSE 0 END, 6) AS score FROM tn) s,
    (SELECT greatest(10, count(*) // 10) AS keep FROM tn) z"""
_TOP = f"(SELECT * FROM (SELECT s.*, z.keep, row_number() OVER (ORDER BY s.score DESC, s.seq) AS r FROM {_PEAKS}) WHERE r <= keep)"


@query(f"SELECT a.id AS src, b.id AS dst FROM {_TOP} a JOIN {_TOP} b ON a.seq < b.seq WHERE b.seq - a.seq < 500 OR a.role = b.role", "tn")
def peak_pairs(spark, sf):
    return candidates.peak_pairs(candidates.peak_events(materialize(D.turns(spark, sf).drop("text"), "turns")))


CTE["tok"] = r"SELECT id, seq, term, count(*) AS tf FROM (SELECT id, seq, unnest(string_split_regex(lower(text), '\s+')) AS term FROM tn) WHERE term <> '' GROUP BY id, seq, term"
CTE["wgt"] = """SELECT t.id, t.seq, t.term, i.idf * t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * l.len / c.mean)) AS w FROM tok t
    JOIN (SELECT id, sum(tf) AS len FROM tok GROUP BY id) l ON l.id = t.id
    JOIN (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (
        SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM tok GROUP BY term), (SELECT count(*) AS n FROM tn))) i ON i.term = t.term,
    (SELECT (SELECT sum(tf) FROM tok) / (SELECT count(*) FROM tn) AS mean) c"""
CTE["bm"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) AS r FROM (
    SELECT q.id AS query, q.seq AS query_seq, d.id, d.seq, round(sum(q.tf * d.w), 6) AS score FROM tok q JOIN wgt d ON q.term = d.term AND q.id <> d.id
    GROUP BY q.id, q.seq, d.id, d.seq) WHERE score > 0) WHERE r <= 10"""
_CTE_NEEDS |= {"tok": ["tn"], "wgt": ["tok"], "bm": ["wgt"]}


@query("SELECT DISTINCT least(query_seq, seq) AS src, greatest(query_seq, seq) AS dst FROM bm", "bm")
def bm25_pairs(spark, sf):
    return bm25.bm25_pairs(D.turns(spark, sf).select("id", "seq", "text"))


def _all_pools(spark, sf) -> tuple[DataFrame, DataFrame]:
    ev, ve = materialize(D.order(spark, sf), "order"), D.vectors(spark, sf)
    pools = D.local_pools(ev) | {"scene": similarity.scene_pairs(ve, SIMILAR), "longshot": similarity.longshot_pairs(ve, SIMILAR)}
    return ev, candidates.pooled(pools)


@query("SELECT * FROM pools", "pools")
def candidate_union(spark, sf):
    return _all_pools(spark, sf)[1]


_PRIORITY = "CASE WHEN pools & 8 <> 0 THEN 0 WHEN pools & 16 <> 0 THEN 1 WHEN pools & 4 <> 0 THEN 3 WHEN pools & 2 <> 0 THEN 4 ELSE 5 END"


@query(f"""SELECT p.src, p.dst, p.pools, b.seq - a.seq AS gap, {_PRIORITY} AS priority FROM pools p JOIN ev a ON a.id = p.src JOIN ev b ON b.id = p.dst
    ORDER BY priority, gap, src, dst LIMIT {MAX_PAIRS}""", "pools", "ev")
def candidate_priority_cap(spark, sf):
    ev, pairs = _all_pools(spark, sf)
    return candidates.priority_cap(candidates.with_gap(pairs, ev), D.pool_names(), MAX_PAIRS)


@query(f"""SELECT src, dst, pools, gap, tier FROM (SELECT u.*, b.seq - a.seq AS gap, CASE WHEN pools & 1 <> 0 THEN 1 WHEN pools & 6 <> 0 THEN 2 ELSE 3 END AS tier FROM (
    SELECT src, dst, CAST(bit_or(b) AS INTEGER) AS pools FROM (
        SELECT a.id AS src, b.id AS dst, 1 AS b FROM {_TOP} a JOIN {_TOP} b ON a.seq < b.seq WHERE b.seq - a.seq < 500 OR a.role = b.role
        UNION ALL SELECT * FROM (SELECT id, lead(id) OVER (PARTITION BY role ORDER BY seq) AS n, 2 FROM tn) WHERE n IS NOT NULL
        UNION ALL SELECT a.id, b.id, 4 FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq DESC) AS r, dense_rank() OVER (ORDER BY chapter) AS c FROM tn) a
            JOIN (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq) AS r, dense_rank() OVER (ORDER BY chapter) AS c FROM tn) b ON b.c = a.c + 1 WHERE a.r <= 5 AND b.r <= 5
        UNION ALL SELECT a.id, b.id, 8 FROM tn a JOIN tn b ON b.seq - a.seq BETWEEN 1 AND 50 WHERE b.seq - a.seq < 20 OR a.chapter = b.chapter) GROUP BY src, dst) u
    JOIN tn a ON a.id = u.src JOIN tn b ON b.id = u.dst) ORDER BY tier, CASE WHEN tier = 1 THEN (src * 7919 + dst * 104729) % 1000003 ELSE gap END, src, dst LIMIT {TIER_PAIRS}""", "tn")
def candidate_tier_cap(spark, sf):
    rows = D.turns(spark, sf)
    rows = materialize(rows.drop("text"), "turns")
    n = rows.count()
    pools = {"peak": candidates.peak_gaps(candidates.peak_events(rows)), "entity": candidates.entity_gaps(D.occurrences(rows, "role"), n), "chapter": candidates.chapter_transition_pairs(rows), "temporal": candidates.temporal_gaps(rows)}
    return candidates.capped(pools, rows, TIER_PAIRS, candidates.tier_cap)


@query("""SELECT n.pool, count(*) AS pairs, CAST(sum(CASE WHEN p.pools = n.b THEN 1 ELSE 0 END) AS BIGINT) AS only FROM pools p
    JOIN (SELECT unnest(['adjacent', 'window', 'entity', 'scene', 'longshot']) AS pool, unnest([1, 2, 4, 8, 16]) AS b) n ON p.pools & n.b <> 0 GROUP BY n.pool""", "pools")
def pool_contribution(spark, sf):
    return candidates.pool_contribution(_all_pools(spark, sf)[1], D.pool_names())


@query(f"""SELECT query, passage, rank, round(score, 6) AS score FROM (SELECT b.id AS query, a.id AS passage, {_COS} AS score,
    CAST(row_number() OVER (PARTITION BY b.id ORDER BY {_COS} DESC, a.seq) AS INTEGER) AS rank FROM ve a JOIN ve b ON a.id <> b.id AND b.id % 50 = 0 WHERE {_COS} >= {SIMILAR}) WHERE rank <= 2""", "ve")
def passage_topk(spark, sf):
    ve = D.vectors(spark, sf)
    return similarity.passage_topk(ve.filter("id % 50 = 0"), ve, 2, SIMILAR).withColumn("score", F.round("score", 6))


# --- context and order ---


@query("SELECT id, location, time FROM fl", "fl")
def context_ffill(spark, sf):
    return context.fill_context(D.events(spark, sf).select("id", "seq", "location", "time")).select("id", "location", "time")


def _inherited(kinds: str, name: str, strength: str) -> str:
    return f"""SELECT g.id AS event_id, p.entity_name, p.entity_type, {strength} AS strength, g.anchor FROM (
        SELECT id, own, last_value(own IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM (
        SELECT ev.id, ev.seq, h.event_id AS own FROM ev LEFT JOIN (SELECT DISTINCT event_id FROM pr WHERE entity_type IN ({kinds})) h ON h.event_id = ev.id)) g
        JOIN (SELECT *, row_number() OVER (PARTITION BY event_id, {name} ORDER BY ord DESC) AS rn FROM pr WHERE entity_type IN ({kinds})) p
        ON p.event_id = g.anchor AND p.rn = 1 WHERE g.own IS NULL"""


@query(_inherited("'actor', 'patient'", "lower(entity_name)", "CAST(0.5 AS DOUBLE)"), "ev", "pr")
def actor_propagation(spark, sf):
    ev = D.events(spark, sf)
    return context.propagate_actors(ev, D.productions(ev))


@query(_inherited("'whyfactor'", "ord", "p.strength"), "ev", "pr")
def whyfactor_propagation(spark, sf):
    ev = D.events(spark, sf)
    return context.propagate_reasons(ev, D.productions(ev).drop("event_seq", "text"))


@query("""SELECT id AS event_id, place AS entity_name, 'place' AS entity_type, CAST(CASE WHEN nullif(location, '') IS NOT NULL THEN 0.8 ELSE 0.5 END AS DOUBLE) AS strength FROM (
    SELECT id, location, last_value(nullif(location, '') IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM ev) WHERE place IS NOT NULL""", "ev")
def location_propagation(spark, sf):
    return context.propagate_places(D.events(spark, sf))


@query("""SELECT id, name, last_value(CASE WHEN name <> 'he' THEN name END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS resolved
    FROM (SELECT id, seq, CASE WHEN user_id % 3 = 0 THEN 'he' ELSE 'U' || user_id END AS name FROM ev)""", "ev")
def pronoun_resolution(spark, sf):
    rows = D.order(spark, sf).select("id", "seq", F.when(F.col("user_id") % 3 == 0, "he").otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("name"))
    return context.resolve_pronouns(rows, F.col("name").isin(*V.PRONOUNS)).select("id", "name", "resolved")


@query("SELECT src, dst FROM (SELECT id AS src, lead(id) OVER (ORDER BY seq) AS dst, chapter, lead(chapter) OVER (ORDER BY seq) AS c FROM ev) WHERE chapter = c", "ev")
def follows_edges(spark, sf):
    return follows(D.order(spark, sf))


# --- causal links ---


@query("SELECT src, dst, relation, theory, confidence, src_seq, dst_seq FROM lk", "lk")
def causal_admission(spark, sf):
    return D.links(spark, D.order(spark, sf)).select("src", "dst", "relation", "theory", "confidence", "src_seq", "dst_seq")


@query("SELECT o.theory, count(*) AS valid, count(k.src) AS admitted FROM ok o LEFT JOIN lk k ON k.src = o.src AND k.dst = o.dst AND k.theory = o.theory GROUP BY o.theory", "lk")
def mixed_theory_dedupe(spark, sf):
    ev = D.order(spark, sf)
    valid = causal.valid_assessments(D.assessed(candidates.pooled(D.local_pools(ev)).select("src", "dst")), causal.relation_types(spark))
    admitted = causal.theory_counts(causal.admit(valid, ev)).withColumnRenamed("links", "admitted")
    return valid.groupBy("theory").agg(F.count("*").alias("valid")).join(admitted, "theory", "left").select("theory", "valid", F.coalesce("admitted", F.lit(0)).cast("long").alias("admitted"))


@query("""SELECT (SELECT count(*) FROM ev) AS nodes, (SELECT count(*) FROM lk) AS edges, (SELECT max(c) FROM (SELECT count(*) AS c FROM lk GROUP BY dst)) AS max_in,
    (SELECT max(c) FROM (SELECT count(*) AS c FROM lk GROUP BY src)) AS max_out, round((SELECT count(*) FROM lk) / (SELECT count(*) FROM ev), 2) AS avg_in""", "lk", "ev")
def dag_stats(spark, sf):
    ev = D.order(spark, sf)
    return causal.dag_stats(D.links(spark, ev), ev, D.LINKS * _n_events(spark, sf))


@query("SELECT count(*) AS links, CAST(coalesce(sum(CASE WHEN src_seq >= dst_seq THEN 1 ELSE 0 END), 0) AS BIGINT) AS backward FROM lk", "lk")
def dag_valid(spark, sf):
    return causal.backward_edges(D.links(spark, D.order(spark, sf)))


_SUPER = "CASE " + " ".join(f"WHEN relation IN ({', '.join(repr(x) for x in fine)}) THEN '{broad}'" for broad, fine in V.SUPERTYPES.items()) + " END"


@query(f"SELECT relation, {_SUPER} AS edge_supertype, count(*) AS links FROM lk GROUP BY relation", "lk")
def edge_supertype(spark, sf):
    return causal.with_supertype(D.links(spark, D.order(spark, sf))).groupBy("relation", "edge_supertype").agg(F.count("*").alias("links"))


def _neighbours(here: str, there: str) -> str:
    return f"""(SELECT {here} AS id, string_agg(t, '; ' ORDER BY r) AS s FROM (SELECT l.{here}, e.event_type || ' ' || e.id AS t,
        row_number() OVER (PARTITION BY l.{here} ORDER BY l.src_seq * 1000003 + l.dst_seq, l.{there}) AS r FROM lk l JOIN ev e ON e.id = l.{there}) WHERE r <= 2 GROUP BY {here})"""


@query(f"SELECT coalesce(c.id, e.id) AS id, coalesce(c.s, '') AS causes, coalesce(e.s, '') AS effects FROM {_neighbours('dst', 'src')} c FULL JOIN {_neighbours('src', 'dst')} e ON c.id = e.id", "lk", "ev")
def causal_context_top2(spark, sf):
    ev = D.order(spark, sf)
    rows = D.links(spark, ev).select("src", "dst", (F.col("src_seq") * 1000003 + F.col("dst_seq")).alias("ord"))
    return causal.first_neighbours(rows, ev.select("id", F.concat_ws(" ", "event_type", F.col("id").cast("string")).alias("text")))


@query("SELECT CAST(src AS VARCHAR) AS start, 'assertion__' || src || '__' || dst AS \"end\", 'CAUSE' AS type FROM lk UNION ALL SELECT 'assertion__' || src || '__' || dst, CAST(dst AS VARCHAR), 'EFFECT' FROM lk", "lk")
def causal_assertions(spark, sf):
    return graph.causal_assertions(D.links(spark, D.order(spark, sf)))


@query("""SELECT DISTINCT cause, effect, round(cc * ec, 4) AS weight, round(0.8 * least(cc, ec), 4) AS confidence FROM (
    SELECT e.id AS effect, e.confidence AS ec, c.id AS cause, c.confidence AS cc, row_number() OVER (PARTITION BY e.id ORDER BY c.seq DESC) AS r
    FROM tn e JOIN tn c ON c.chapter = e.chapter AND c.role = e.role AND c.id <> e.id WHERE contains(lower(e.text), 'an')) WHERE r = 1""", "tn")
def because_links(spark, sf):
    return tools.because_links(D.turns(spark, sf).withColumn("actor", F.col("role")), "an")


# --- scenes and themes ---


_JOINED = "coalesce((SELECT string_agg(n, '|' ORDER BY n) FROM (SELECT DISTINCT entity_name AS n FROM pa WHERE pa.scene = ru.scene AND entity_type IN ({}))), '') AS {}"


@query(f"SELECT ru.*, {_JOINED.format(chr(39) + 'actor' + chr(39) + ', ' + chr(39) + 'patient' + chr(39), 'participants')}, {_JOINED.format(chr(39) + 'whyfactor' + chr(39), 'reasons')} FROM ru", "ru", "pa")
def scene_rollup(spark, sf):
    ev = D.events(spark, sf)
    out = scenes.rollup(D.members(ev), context.fill_context(ev), D.productions(ev))
    return out.select("scene", "chapter", "n_events", "location", "time", *(F.array_join(c, "|").alias(c) for c in ("participants", "reasons")))


@query("SELECT chapter, count(*) AS n_events, min(id) AS first_id, 'Chapter ' || chapter || ' events' AS theme, CAST(0.5 AS DOUBLE) AS confidence FROM ev WHERE id NOT IN (SELECT id FROM mb) GROUP BY chapter", "ev", "mb")
def orphan_scenes(spark, sf):
    ev = D.order(spark, sf)
    return scenes.orphan_scenes(ev, D.members(ev))


@query("SELECT id, arg_max(scene, scene_ord) AS scene FROM mb GROUP BY id", "mb")
def scene_last_wins(spark, sf):
    return scenes.last_scene(D.members(D.order(spark, sf)))


@query("SELECT * FROM (SELECT m.scene, m.id AS src, lead(m.id) OVER (PARTITION BY m.scene ORDER BY e.seq, m.id) AS dst FROM mb m JOIN ev e ON e.id = m.id) WHERE dst IS NOT NULL", "mb", "ev")
def scene_stitch(spark, sf):
    ev = D.order(spark, sf)
    return scenes.stitched(D.members(ev), ev)


@query("SELECT * FROM nt", "nt")
def theme_clean(spark, sf):
    return themes.cleaned(D.notes(D.order(spark, sf)))


@query("SELECT * FROM nb", "nb")
def theme_bridge(spark, sf):
    ev = D.order(spark, sf)
    return themes.bridged(themes.cleaned(D.notes(ev)), D.links(spark, ev), D.LINKS * _n_events(spark, sf))


@query("SELECT id, " + ", ".join(f"coalesce(max(CASE WHEN theme = '{t}' THEN involvement END), 'none') AS \"theme_{t}\"" for t in V.THEMES) + " FROM nb GROUP BY id", "nb")
def theme_flatten(spark, sf):
    ev = D.order(spark, sf)
    n = D.LINKS * _n_events(spark, sf)
    return themes.flattened(themes.bridged(themes.cleaned(D.notes(ev)), D.links(spark, ev), n), ev, n)


# --- names and model answers ---


@query("""SELECT name, mentions, descriptions FROM (SELECT entity_name AS name, count(*) AS mentions, string_agg(CASE WHEN r <= 10 THEN t END, '|' ORDER BY r) AS descriptions FROM (
    SELECT p.entity_name, e.event_type || ' ' || e.id AS t, row_number() OVER (PARTITION BY p.entity_name ORDER BY p.event_seq, p.ord) AS r FROM pr p JOIN ev e ON e.id = p.event_id
    WHERE p.entity_type IN ('actor', 'patient')) GROUP BY entity_name) WHERE mentions >= 2""", "pr", "ev")
def agent_mentions(spark, sf):
    return coreference.mentions_of(D.productions(D.events(spark, sf))).withColumn("descriptions", F.array_join("descriptions", "|"))


@query("""SELECT a, b, count(*) AS events FROM (SELECT DISTINCT x.l_orderkey, 'S' || x.l_suppkey AS a, 'S' || y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey
    AND 'S' || x.l_suppkey < 'S' || y.l_suppkey) GROUP BY a, b HAVING count(*) >= 3""")
def cooccurrence(spark, sf):
    rows = D.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity_name"), F.lit("actor").alias("entity_type"))
    return coreference.cooccurrences(rows, n=rows.count())


_NAMES = ("Young {}", "Mr. {}", "{} (Child)", "He", "his sister", "the man", "Herbert {}", "The Captain", "Little Old Dr. {} (of town)", "X", "everyone", "Sir")
_NAMED = "SELECT c_custkey AS id, CASE c_custkey % 12 " + " ".join(f"WHEN {i} THEN replace('{n}', '{{}}', c_name)" for i, n in enumerate(_NAMES)) + " END AS name FROM customer"
CTE["cn"] = _NAMED


def _names(spark, sf) -> DataFrame:
    return D.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.replace(D.pick(F.col("c_custkey") % 12, _NAMES), F.lit("{}"), F.col("c_name")).alias("name"))


_PRON, _GEN = "|".join(V.PRONOUNS), ", ".join(repr(g) for g in V.GENERIC_NAMES)


@query(rf"""SELECT id, name, NOT (length(x) < 2 OR x IN ({_GEN}) OR regexp_matches(x, '^({_PRON})\b') OR (regexp_matches(x, '^(the|a|an) ') AND regexp_replace(x, '^(the|a|an) ', '') IN ({_GEN}))) AS valid,
    NOT (length(x) < 2 OR x IN ({_GEN}) OR regexp_matches(x, '^({_PRON})') OR (regexp_matches(x, '^(the|a|an) ') AND regexp_replace(x, '^(the|a|an) ', '') IN ({_GEN}))) AS legacy
    FROM (SELECT *, trim(lower(name)) AS x FROM cn)""", "cn")
def character_filter(spark, sf):
    return _names(spark, sf).select("id", "name", X.is_character("name").alias("valid"), X.is_character("name", legacy_prefix=True).alias("legacy"))


CTE["n0"] = r"SELECT id, name, regexp_replace(name, '\s*\([^)]*\)', '', 'g') AS x FROM cn"
_CTE_NEEDS["n0"] = ["cn"]
for _i, _w in enumerate(V.AGE_WORDS, start=1):
    CTE[f"n{_i}"] = f"SELECT id, name, CASE WHEN starts_with(x, '{_w} ') THEN trim(substr(x, {len(_w) + 1})) ELSE x END AS x FROM n{_i - 1}"
    _CTE_NEEDS[f"n{_i}"] = [f"n{_i - 1}"]


@query(rf"""SELECT id, name, trim(CASE WHEN len(w) > 1 AND w[1] IN ({', '.join(repr(t) for t in V.TITLES)}) THEN array_to_string(w[2:], ' ') ELSE x END) AS normal
    FROM (SELECT *, list_filter(string_split_regex(x, '\s+'), lambda y: y <> '') AS w FROM n{len(V.AGE_WORDS)})""", f"n{len(V.AGE_WORDS)}")
def name_normalize(spark, sf):
    return _names(spark, sf).select("id", "name", X.normalized_name("name").alias("normal"))


@query()
def character_coreference(spark, sf):
    """Folds of ordered mentions have no SQL form; tests hold the registry against brute force."""
    rows = _names(spark, sf).select((F.col("id") % 16).alias("book"), F.col("id").alias("seq"), F.lit(0).alias("ord"), "name")
    return coreference.resolve_characters(rows)


@query("""SELECT id, round(0.6 * coalesce(CASE WHEN id % 7 <> 0 THEN round((id % 100) / 100, 2) END, 0.7) + 0.4 * (1.0 - CASE WHEN id % 3 <> 0 THEN 0.0 ELSE 0.2 END
    - CASE WHEN nullif(location, '') IS NOT NULL THEN 0.0 ELSE 0.1 END), 4) AS confidence FROM ev""", "ev")
def confidence_calibration(spark, sf):
    p = F.when(F.col("id") % 7 != 0, F.round((F.col("id") % 100) / 100, 2))
    return D.events(spark, sf).select("id", X.calibrated(p, F.col("id") % 3 != 0, X.missing_as_null("location").isNotNull()).alias("confidence"))


@query("""SELECT id, CASE WHEN total > 0 THEN round(value / total, 3) ELSE round(1.0 / 3, 3) END AS a, CASE WHEN total > 0 THEN round((id % 7) / total, 3) ELSE round(1.0 / 3, 3) END AS b
    FROM (SELECT id, value, value + id % 7 + user_id % 3 AS total FROM ev)""", "ev")
def weight_normalize(spark, sf):
    w = X.normalized_weights(F.array(F.col("value"), (F.col("id") % 7).cast("double"), (F.col("user_id") % 3).cast("double"), F.lit(None).cast("double")))
    return D.events(spark, sf).select("id", w.alias("w")).select("id", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))


_TYPES = {"purchase": "ACQUISITION", "view": "OBSERVATION", "error": "GLITCH"}


@query("SELECT raw, CASE WHEN raw IN (" + ", ".join(repr(t) for t in V.EVENT_TYPES) + ") THEN raw ELSE 'PHYSICAL_ACTION' END AS action_type, count(*) AS events FROM (SELECT coalesce("
       + _list(_TYPES.values()) + "[list_position(" + _list(_TYPES) + ", event_type)], upper(event_type)) AS raw FROM ev) GROUP BY raw", "ev")
def event_type_validate(spark, sf):
    raw = F.col("event_type")
    for a, b in _TYPES.items():
        raw = F.when(F.col("event_type") == a, b).otherwise(raw)
    rows = D.order(spark, sf).select(F.upper(raw).alias("raw"))
    return rows.groupBy("raw", parsing.event_type(F.col("raw")).alias("action_type")).agg(F.count("*").alias("events"))


@query("""SELECT CAST(chapter AS BIGINT) AS chapter, seq, text AS description, CASE WHEN role = 'system' THEN 'OBSERVATION' WHEN role = 'user' THEN 'PHYSICAL_ACTION' ELSE 'OTHER' END AS action_type,
    CASE WHEN turn % 2 = 0 THEN role || '|x' ELSE role END AS actors, CASE WHEN turn % 3 = 0 THEN 'hall' END AS location,
    round(0.6 * coalesce(CASE WHEN turn % 4 <> 0 THEN 0.5 END, 0.7) + 0.4 * (1.0 - 0.0 - CASE WHEN turn % 3 = 0 THEN 0.0 ELSE 0.1 END), 4) AS confidence FROM tn""", "tn")
def event_parse(spark, sf):
    rows = D.turns(spark, sf)
    turn = F.col("turn")
    event = F.struct(
        F.col("text").alias("raw_description"), F.when(F.col("role") == "system", "observation").alias("event_category"), F.when(F.col("role") == "user", "shouting").alias("action_type"),
        F.when(turn % 3 == 0, "hall").otherwise("").alias("location_context"), F.when(turn % 4 != 0, 0.5).alias("confidence"),
    )
    body = F.to_json(event)
    actors = F.when(turn % 2 == 0, F.to_json(F.array("role", F.lit("x")))).otherwise(F.to_json(F.struct(F.col("role").alias("a"))))
    actors = F.when(turn % 2 == 0, actors).otherwise(F.regexp_extract(actors, r"^\{\"a\":(.*)\}$", 1))
    body = F.concat(F.lit('{"actors":'), actors, F.lit(","), F.substr(body, F.lit(2)))
    answer = F.when(turn % 3 == 0, F.concat(F.lit("```json\n{\"events\":["), body, F.lit("]}\n```"))).when(turn % 3 == 1, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    answers = rows.select("chapter", turn.alias("chunk"), answer.alias("answer"))
    out = parsing.parse_events(answers)
    return out.select(F.col("chapter").cast("long").alias("chapter"), "seq", "description", "action_type", F.array_join("actors", "|").alias("actors"), "location", "confidence")


@query("SELECT verb, " + _list(V.VERB_ACTIONS.values()) + "[list_position(" + _list(V.VERB_ACTIONS) + ", lower(verb))] AS action, count(*) AS events FROM (SELECT "
       + _list(("Say", "see", "ask", "run", "go", "VOW", "gaze")) + "[1 + id % 7] AS verb FROM ev) GROUP BY verb", "ev")
def verb_actions(spark, sf):
    rows = D.order(spark, sf).select(D.pick(F.col("id") % 7, ("Say", "see", "ask", "run", "go", "VOW", "gaze")).alias("verb"))
    return rows.groupBy("verb").agg(F.count("*").alias("events")).withColumn("action", tools.verb_action("verb"))


def _why_sql() -> str:
    score = {c: " + ".join(f"CASE WHEN contains(t, '{w}') THEN {1.0 / (1 + abs(len(w) - 4))!r}::DOUBLE ELSE 0 END" for w in ws) for c, ws in V.WHY_LEXICON.items()}
    rows = " UNION ALL ".join(f"SELECT id, '{c}' AS category, {s} AS score, {V.WHY_RANGES[c][0]}::DOUBLE AS lo, {V.WHY_RANGES[c][1]}::DOUBLE AS hi FROM (SELECT id, lower(text) AS t FROM tn)" for c, s in score.items())
    return f"""SELECT id, category, round(w / sum(w) OVER (PARTITION BY id), 3) AS weight FROM (SELECT id, category, round(lo + (hi - lo) * (score / sum(score) OVER (PARTITION BY id)), 3) AS w FROM ({rows}) WHERE score > 0)
        UNION ALL SELECT id, 'Contextual Cause', 0.25 FROM tn WHERE id NOT IN (SELECT id FROM ({rows}) WHERE score > 0)"""


@query(_why_sql(), "tn")
def why_factors(spark, sf):
    return tools.why_factors(D.turns(spark, sf))


@query("""SELECT CAST(greatest(20, least(50, CAST(floor(11500 / ((c + e) / 4 + 80)) AS INTEGER))) AS INTEGER) AS bulk FROM (
    SELECT avg(length(text)) AS c, avg(length(n)) AS e FROM (SELECT text, lead(text) OVER (ORDER BY seq) AS n, seq FROM tn) WHERE seq < 50)""", "tn")
def prompt_bulk_size(spark, sf):
    from .operators.ordering import ahead

    rows = ahead(D.turns(spark, sf), [], "seq", F.col("text"), range(1, 2), "n")
    return bulk_size(rows.select(F.col("seq").alias("ord"), F.col("text").alias("cause_text"), F.get("n", F.lit(0)).alias("effect_text")))


@query("SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS rank, CAST((row_number() OVER (ORDER BY term) - 1) // 300 AS BIGINT) AS batch FROM (SELECT DISTINCT replace(upper(trim(p_name)), ' ', '_') AS term FROM part) WHERE term <> ''")
def ontology_terms(spark, sf):
    return tools.ontology_terms(D.load(spark, sf, "part").select(F.col("p_name").alias("term")))


@query("SELECT kind, name, theory FROM (" + " UNION ALL ".join([f"SELECT 'event' AS kind, unnest({_list(V.EVENT_TYPES)}) AS name, '@McKee' AS theory"]
       + [f"SELECT 'relation', unnest({_list(ns)}), '{t}'" for t, ns in V.RELATION_TYPES.items()] + [f"SELECT 'agent', unnest({_list(V.AGENT_TYPES)}), '@McKee'"]) + ")")
def default_ontology(spark, sf):
    return tools.default_ontology(spark)


# --- texts ---


_ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")


@query(rf"""SELECT book, number, body FROM (SELECT book, CAST(n AS INTEGER) AS number, regexp_replace(parts[n + 1], '^\s+|\s+$', '', 'g') AS body FROM (
    SELECT book, parts, unnest(range(1, len(parts))) AS n FROM (SELECT chapter AS book, string_split_regex('Title' || chr(10) || string_agg('Chapter ' || {_list(_ROMAN)}[1 + turn % 12] || '.' || chr(10) || text, chr(10) ORDER BY seq),
    '(?m)^Chapter\s+[IVXLCDM]+\.\s*$') AS parts FROM tn GROUP BY chapter))) WHERE body <> ''""", "tn")
def chapter_split(spark, sf):
    rows = D.turns(spark, sf).select("chapter", "seq", F.concat(F.lit("Chapter "), D.pick(F.col("turn") % 12, _ROMAN), F.lit(".\n"), F.col("text")).alias("t"))
    book = F.concat(F.lit("Title\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda s: s["t"]), "\n"))
    books = rows.groupBy(F.col("chapter").alias("book")).agg(book.alias("text"))
    return books.select("book", F.explode(T.chapters("text")).alias("c")).select("book", "c.number", "c.body")


@query(r"""SELECT doc_id, CAST(n AS INTEGER) AS number, ps[n] AS body FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS n FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents))""")
def document_paragraphs(spark, sf):
    return D.load(spark, sf, "documents").select("doc_id", F.explode(T.chapters("text")).alias("c")).select("doc_id", "c.number", "c.body")


@query(S.SENTENCE_CHUNKS)
def sentence_chunks(spark, sf):
    return D.load(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks("text")).alias("chunk", "text"))


@query(S.PARAGRAPH_CHUNKS)
def paragraph_chunks(spark, sf):
    return D.load(spark, sf, "documents").select("doc_id", F.posexplode(T.paragraphs("text")).alias("piece", "text"))


@query(S.PASSAGES)
def passages(spark, sf):
    return D.load(spark, sf, "documents").select("doc_id", F.posexplode(T.passages("text")).alias("passage", "text"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS piece, CASE WHEN length(text) <= 3000 THEN text ELSE substring(text, CAST(floor(i * (length(text) - 3000) / 5) AS BIGINT) + 1, 3000) END AS text
    FROM documents, (SELECT unnest(range(5)) AS i) WHERE text IS NOT NULL AND (length(text) > 3000 OR i = 0)""")
def sampled_windows(spark, sf):
    return D.load(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(T.sampled_windows("text")).alias("piece", "text"))


@query(r"SELECT id, CASE WHEN length(t) > 60 THEN regexp_replace(left(t, 60), '\\+$', '') ELSE t END AS cut FROM (SELECT id, replace(text, 'a', '\\') AS t FROM tn)", "tn")
def safe_truncation(spark, sf):
    return D.turns(spark, sf).select("id", X.truncate_safe(F.replace("text", F.lit("a"), F.lit("\\\\")), 60).alias("cut"))


# --- graph and export ---


def _graph_parts(spark, sf):
    ev = D.events(spark, sf)
    return ev, D.productions(ev), D.members(ev)


@query("""SELECT CAST(id AS VARCHAR) AS uid, 'Event' AS label, event_type || ' ' || id AS name FROM ev UNION ALL SELECT uid, label, name FROM en
    UNION ALL SELECT scene, 'Scene', 'Chapter ' || chapter FROM (SELECT DISTINCT scene, chapter FROM mb)""", "ev", "en", "mb")
def graph_nodes(spark, sf):
    ev, pr, mb = _graph_parts(spark, sf)
    table = mb.select("scene", "chapter").distinct().select("scene", F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("theme"))
    return graph.nodes(ev.withColumn("name", F.concat_ws(" ", "event_type", F.col("id").cast("string"))), pr, table)


@query("""SELECT scene AS start, CAST(id AS VARCHAR) AS "end", 'INCLUDES' AS type FROM mb
    UNION ALL SELECT DISTINCT pa.scene, u.uid, CASE WHEN pa.entity_type = 'whyfactor' THEN 'HAS_MOTIVATION' ELSE 'HAS_PARTICIPANT' END FROM pa JOIN (SELECT DISTINCT entity_type, entity_name, uid FROM uid) u ON u.entity_type = pa.entity_type AND u.entity_name = pa.entity_name
    UNION ALL SELECT uid, CAST(event_id AS VARCHAR), CASE entity_type WHEN 'actor' THEN 'ACTS_IN' WHEN 'patient' THEN 'AFFECTED_IN' ELSE 'MOTIVATES' END FROM uid
    UNION ALL SELECT CAST(src AS VARCHAR), CAST(dst AS VARCHAR), 'FOLLOWS' FROM (SELECT id AS src, lead(id) OVER (ORDER BY seq) AS dst, chapter, lead(chapter) OVER (ORDER BY seq) AS c FROM ev) WHERE chapter = c
    UNION ALL SELECT CAST(src AS VARCHAR), CAST(dst AS VARCHAR), relation FROM lk""", "mb", "pa", "uid", "ev", "lk")
def graph_edges(spark, sf):
    ev, pr, mb = _graph_parts(spark, sf)
    return graph.edges(ev, pr, mb, scenes.rollup(mb, ev, pr), D.links(spark, ev))


@query("""SELECT key || '@' || id AS start, next_event, type, strength FROM (SELECT p.entity_type || ':' || lower(entity_name) AS key, event_id AS id,
    lead(event_id) OVER (PARTITION BY entity_type, lower(entity_name) ORDER BY event_seq, event_id) AS next_event,
    CASE entity_type WHEN 'actor' THEN 'ACTS_IN' WHEN 'patient' THEN 'AFFECTED_IN' ELSE 'MOTIVATES' END AS type, strength FROM pr p) WHERE next_event IS NOT NULL""", "pr")
def chain_links(spark, sf):
    return graph.chain_links(D.productions(D.events(spark, sf)))


@query("""SELECT s AS src, d AS dst, type FROM (SELECT unnest(list_distinct([id, id, id + 1, id + 1])) AS s, id, type FROM (SELECT id, ['CONTRAST', 'ELABORATION', 'PARALLELISM', 'EXPLANATION'][1 + id % 4] AS type FROM ev)),
    LATERAL (SELECT unnest([id + 1, id + 2]) AS d) WHERE s <> d""", "ev")
def semantic_links(spark, sf):
    i = F.col("id")
    rows = D.order(spark, sf).select(F.array(i, i + 1).alias("sources"), F.array(i + 1, i + 2).alias("targets"), D.pick(i % 4, ("CONTRAST", "ELABORATION", "PARALLELISM", "EXPLANATION")).alias("type"))
    return graph.expanded_semantic_links(rows)


def _cypher_text(x: str) -> str:
    return f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


@query(f"""SELECT 'MERGE (n:' || label || ' {{id: ' || {_cypher_text('uid')} || '}}) ON CREATE SET n = {{id: ' || {_cypher_text('uid')} || ', name: ' || {_cypher_text('name')} || ', entity_type: ' || {_cypher_text('entity_type')} || '}};' AS statement FROM en
    UNION ALL SELECT 'MATCH (a {{id: "' || src || '"}}), (b {{id: "' || dst || '"}}) MERGE (a)-[r:' || relation || ']->(b) SET r = {{theory: "' || theory || '", gap: ' || (dst_seq - src_seq) || '}};' FROM lk""", "en", "lk")
def cypher_rows(spark, sf):
    ev = D.events(spark, sf)
    nodes = W.node_statements(graph.entity_nodes(D.productions(ev)), {"name": "string", "entity_type": "string"})
    links = D.links(spark, ev).select(F.col("src").cast("string").alias("start"), F.col("dst").cast("string").alias("end"), F.col("relation").alias("type"), "theory", (F.col("dst_seq") - F.col("src_seq")).alias("gap"))
    return nodes.select("statement").unionByName(W.edge_statements(links, {"theory": "string", "gap": "number"}).select("statement"))


@query(f"""SELECT src || '__CAUSES__' || dst AS id, 'CausalEdge' AS type, CAST(to_json({{'@id': src || '__CAUSES__' || dst, 'type': 'CausalEdge', 'from': src, 'to': dst, 'relationType': relation, 'mechanism': NULL, 'weight': 0,
    'confidence': confidence, 'edge_supertype': {_SUPER}}}) AS VARCHAR) AS json FROM lk""", "lk")
def jsonld_rows(spark, sf):
    rows = causal.with_supertype(D.links(spark, D.order(spark, sf))).withColumn("mechanism", F.lit(None).cast("string")).withColumn("weight", F.lit(0))
    return W.jsonld_links(rows)


@query("""SELECT n.id, n.label, n.type, CASE WHEN n.type = 'Event' THEN n.grp ELSE n.type END AS "group", CASE WHEN n.type = 'Event' THEN coalesce(s.scene, 'No Scene') ELSE 'N/A' END AS scene_name, CASE WHEN n.type = 'Event' THEN 1 ELSE 15 END AS size
    FROM (SELECT CAST(id AS VARCHAR) AS id, event_type || ' ' || id AS label, 'Event' AS type, event_type AS grp FROM ev UNION ALL SELECT uid, name, label, NULL FROM en
    UNION ALL SELECT DISTINCT scene, 'Chapter ' || chapter, 'Scene', NULL FROM mb) n LEFT JOIN (SELECT CAST(id AS VARCHAR) AS id, arg_max(scene, scene_ord) AS scene FROM mb GROUP BY id) s ON s.id = n.id""", "ev", "en", "mb")
def consolidated_nodes(spark, sf):
    ev, pr, mb = _graph_parts(spark, sf)
    none = F.lit(None).cast("string")
    entities = graph.entity_nodes(pr)
    of = lambda label: entities.filter(F.col("label") == label).select(F.col("uid").alias("id"), F.col("name").alias("label"), none.alias("group"))
    scene = mb.select("scene", "chapter").distinct().select(F.col("scene").alias("id"), F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("label"), none.alias("group"))
    event = ev.select("id", F.concat_ws(" ", "event_type", F.col("id").cast("string")).alias("label"), F.col("event_type").alias("group"))
    return tools.consolidated_nodes([("Event", event), ("Agent", of("Agent")), ("WhyFactor", of("WhyFactor")), ("Scene", scene)], scenes.last_scene(mb).withColumnRenamed("scene", "scene_name"))


@query("SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target FROM lk UNION ALL SELECT scene, CAST(id AS VARCHAR) FROM mb", "lk", "mb")
def consolidated_edges(spark, sf):
    ev, _, mb = _graph_parts(spark, sf)
    return tools.consolidated_edges([D.links(spark, ev).select(F.col("src").alias("start"), F.col("dst").alias("end")), mb.select(F.col("scene").alias("start"), F.col("id").alias("end"))])


@query("""SELECT 'events' AS what, count(*) AS n FROM ev UNION ALL SELECT 'productions', count(*) FROM pr UNION ALL SELECT 'links', count(*) FROM lk
    UNION ALL SELECT 'scenes', count(DISTINCT scene) FROM mb UNION ALL SELECT 'characters', count(DISTINCT entity_name) FROM pr WHERE entity_type IN ('actor', 'patient')""", "ev", "pr", "lk", "mb")
def story_stats(spark, sf):
    ev, pr, mb = _graph_parts(spark, sf)
    characters = pr.filter(F.col("entity_type").isin("actor", "patient")).select("entity_name").distinct()
    return run_stats({"events": ev, "productions": pr, "links": D.links(spark, ev), "scenes": mb.select("scene").distinct(), "characters": characters})


# --- run pools, prompts, answers ---

_AGE = "CASE WHEN pools & 4 <> 0 THEN 3 WHEN pools & 2 <> 0 THEN 4 WHEN pools & 1 <> 0 THEN 5 ELSE 6 END"


@query(f"""SELECT p.src, p.dst, p.pools, b.seq - a.seq AS gap, {_AGE} AS priority FROM (SELECT src, dst, CAST(bit_or(b) AS INTEGER) AS pools FROM (
        SELECT src, dst, 1 AS b FROM adj UNION ALL SELECT src, dst, 2 FROM win UNION ALL SELECT src, dst, 4 FROM ent
        UNION ALL SELECT a.id, b.id, 8 FROM ev a JOIN (SELECT unnest(range(1, 6)) AS o) ON true JOIN ev b ON b.seq = a.seq + o) GROUP BY src, dst) p
    JOIN ev a ON a.id = p.src JOIN ev b ON b.id = p.dst ORDER BY priority, gap, src, dst LIMIT {TIER_PAIRS}""", "adj", "win", "ent", "ev")
def fallback_cap(spark, sf):
    """Pairs of a run without vectors: proximity stands in for similarity, under the same cap."""
    ev = materialize(D.order(spark, sf), "order")
    n = ev.count()
    pools = candidates.local_gaps(ev, D.occurrences(ev, "user_id"), n) | {"proximity": candidates.offset_gaps(ev, range(1, 6), rows=n)}
    return candidates.capped(pools, ev, TIER_PAIRS, candidates.priority_cap)


@query("""SELECT DISTINCT src, dst FROM (SELECT a.id AS src, b.id AS dst FROM ev a JOIN (SELECT unnest([1, 2, 3, 4]) AS o) ON true JOIN ev b ON b.seq = a.seq + o
    UNION ALL SELECT * FROM ent UNION ALL SELECT id, lead(id) OVER (PARTITION BY event_type ORDER BY seq) FROM ev) WHERE dst IS NOT NULL AND src <> dst""", "ev", "ent")
def archived_pairs(spark, sf):
    ev = materialize(D.order(spark, sf), "order")
    places = ev.select(F.concat(F.lit("place:"), "event_type").alias("key"), "id", "seq")
    return candidates.archived_pairs(ev, D.occurrences(ev, "user_id"), places)


@query(f"""SELECT doc_id, {', '.join(f"left(text, {n}) AS {k}" for k, n in prompts.CUTS.items())} FROM documents""")
def prompt_texts(spark, sf):
    return D.load(spark, sf, "documents").select("doc_id", *(prompts.cut_text("text", k).alias(k) for k in prompts.CUTS))


@query("""SELECT id, op, CASE WHEN small THEN least(t, 4096) ELSE t END AS tokens FROM (SELECT id, op, small, CAST(CASE op WHEN 'scenes' THEN 16000
        WHEN 'integrated' THEN least(16000, 5000 + 400 * pairs) WHEN 'causal' THEN least(16000, 4000 + 300 * pairs)
        WHEN 'events' THEN CASE WHEN greatest(n // 100, 15) * 400 + 4000 > 12000 THEN 16000 ELSE greatest(n // 100, 15) * 400 + 4000 END ELSE greatest(asked, 8000) END AS BIGINT) AS t FROM (
        SELECT id, ['scenes', 'integrated', 'causal', 'events', 'other'][1 + id % 5] AS op, id % 7 = 0 AS small, id % 60 AS pairs, length(text) * (1 + id % 9) AS n, 100 * (id % 200) AS asked FROM tn))""", "tn")
def prompt_budget(spark, sf):
    i = F.col("id")
    rows = D.turns(spark, sf).select("id", D.pick(i % 5, ("scenes", "integrated", "causal", "events", "other")).alias("op"), F.when(i % 7 == 0, "gpt-3.5-turbo").otherwise("large").alias("model"), (i % 60).alias("pairs"), (F.char_length("text") * (1 + i % 9)).alias("n"), (100 * (i % 200)).alias("asked"))
    return rows.select("id", "op", prompts.token_budget("op", "n", "pairs", "asked", "model").alias("tokens"))


@query("SELECT id, seq, chapter FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq) AS r FROM ev) WHERE r <= 20", "ev")
def prompt_events(spark, sf):
    """A cap of 20 instead of 200, which no chapter of the smallest tables reaches."""
    return prompts.capped_events(D.order(spark, sf).select("id", "seq", "chapter"), 20)


@query("""SELECT kind, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord, name) AS r FROM (
    SELECT ['event', 'relation', 'agent'][1 + user_id % 3] AS kind, min(id) AS ord, 'T' || user_id AS name FROM ev GROUP BY user_id)) WHERE r <= CASE kind WHEN 'relation' THEN 15 ELSE 20 END""", "ev")
def prompt_vocabulary(spark, sf):
    rows = D.order(spark, sf).groupBy("user_id").agg(F.min("id").alias("ord"))
    return prompts.capped_vocabulary(rows.select(D.pick(F.col("user_id") % 3, ("event", "relation", "agent")).alias("kind"), "ord", F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("name")))


@query("""SELECT 'events' AS cache, count(DISTINCT text) AS entries FROM tn UNION ALL SELECT 'pairs', count(DISTINCT role || '::' || text) FROM tn""", "tn")
def cache_statistics(spark, sf):
    rows = D.turns(spark, sf)
    return prompts.cache_sizes({"events": rows.select(X.cache_key("m", "text").alias("key")), "pairs": rows.select(X.cache_key("m", "role", "text").alias("key"))})


@query("""SELECT 'registered_characters' AS what, count(DISTINCT entity_name) AS n FROM pr WHERE entity_type = 'actor'
    UNION ALL SELECT 'total_aliases', count(*) FROM (SELECT DISTINCT entity_name, event_id % 3 FROM pr WHERE entity_type = 'actor') UNION ALL SELECT 'cooccurrence_pairs', count(*) FROM adj""", "pr", "adj")
def resolver_statistics(spark, sf):
    ev = D.events(spark, sf)
    pr = D.productions(ev)
    resolved = pr.select(F.concat_ws("/", "entity_name", (F.col("event_id") % 3).cast("string")).alias("mention"), F.when(F.col("entity_type") == "actor", F.col("entity_name")).alias("name"))
    return prompts.resolver_statistics(resolved, candidates.adjacent_pairs(ev))


@query("SELECT id, sha256('m::' || role || '::' || text) AS key, 'event/' || left(sha256(chapter || '|' || seq), 16) AS uid FROM tn", "tn")
def cache_keys(spark, sf):
    return D.turns(spark, sf).select("id", X.cache_key("m", "role", "text").alias("key"), X.natural_id("event", "chapter", "seq").alias("uid"))


@query("""SELECT chapter, count(*) AS chunks, CAST(sum(CASE WHEN seq % 3 = 1 THEN 0 ELSE 1 END) AS BIGINT) AS failed,
    round(sum(CASE WHEN seq % 3 = 1 THEN 0 ELSE 1 END) / count(*), 4) AS rate, round(sum(CASE WHEN seq % 3 = 1 THEN 0 ELSE 1 END) / count(*), 4) > 0.3 AS flagged FROM tn GROUP BY chapter""", "tn")
def chunk_failures(spark, sf):
    """Answers without events, without JSON, and null ones fail."""
    answer = F.when(F.col("seq") % 3 == 1, '{"events": [{"raw_description": "a"}]}').when(F.col("seq") % 6 == 0, '{"events": []}').when(F.col("seq") % 6 == 3, "none")
    return parsing.chunk_failures(D.turns(spark, sf).select("chapter", answer.alias("answer")))


@query("""SELECT name, CASE CAST(right(name, 1) AS INTEGER) % 4 WHEN 0 THEN 'PROTAGONIST_HERO' WHEN 1 THEN 'ALLY_MENTOR' ELSE 'STRUCTURAL_AGENT' END AS agent_type
    FROM (SELECT DISTINCT entity_name AS name FROM pr WHERE entity_type IN ('actor', 'patient'))""", "pr")
def agent_types(spark, sf):
    """Names with an answer, with an unknown one, and with none."""
    names = D.productions(D.events(spark, sf)).filter(F.col("entity_type").isin("actor", "patient")).select(F.col("entity_name").alias("name")).distinct()
    last = F.right("name", F.lit(1)).cast("int") % 4
    answers = names.filter(last < 3).select("name", F.when(last == 0, "PROTAGONIST_HERO").when(last == 1, "ALLY_MENTOR").otherwise("NON_AGENT").alias("agent_type"))
    return assess.agent_types(names, answers)


@query("""SELECT event_id, event_seq, name AS entity_name, kind AS entity_type FROM (
    SELECT id AS event_id, seq AS event_seq, left(k, CAST(1 + id % 3 AS BIGINT)) AS name, 'actor' AS kind FROM ev WHERE k IS NOT NULL
    UNION ALL SELECT id, seq, event_type, 'whyfactor' FROM ev UNION ALL SELECT id, seq, location, 'place' FROM ev WHERE location IS NOT NULL) WHERE length(name) > 1""", "ev")
def short_mentions(spark, sf):
    none = F.array().cast("array<string>")
    rows = D.events(spark, sf).withColumns({"actors": F.when(F.col("k").isNotNull(), F.array(F.left("k", (1 + F.col("id") % 3).cast("int")))).otherwise(none), "patients": none, "why_factors": F.array("event_type")})
    return parsing.productions_of(rows).select("event_id", "event_seq", "entity_name", "entity_type")


@query("""SELECT CAST(id AS VARCHAR) AS uid, 'Event' AS label, event_type || ' ' || id AS name FROM ev
    UNION ALL SELECT uid, label, arg_max(entity_name, ord) FROM (SELECT entity_type || ':' || lower(entity_name) || '@' || event_id AS uid, CASE entity_type WHEN 'whyfactor' THEN 'WhyFactor' ELSE 'Agent' END AS label, entity_name, ord FROM pr) GROUP BY uid, label
    UNION ALL SELECT scene, 'Scene', 'Chapter ' || chapter FROM (SELECT DISTINCT scene, chapter FROM mb)""", "ev", "pr", "mb")
def chain_nodes(spark, sf):
    ev, pr, mb = _graph_parts(spark, sf)
    table = mb.select("scene", "chapter").distinct().select("scene", F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("theme"))
    return graph.chain_nodes(ev.withColumn("name", F.concat_ws(" ", "event_type", F.col("id").cast("string"))), pr, table)


@query("""SELECT scene AS start, CAST(id AS VARCHAR) AS "end", 'INCLUDES' AS type FROM mb
    UNION ALL SELECT CAST(event_id AS VARCHAR), entity_type || ':' || lower(entity_name) || '@' || event_id, 'PRODUCES' FROM pr
    UNION ALL SELECT * FROM (SELECT entity_type || ':' || lower(entity_name) || '@' || event_id, CAST(lead(event_id) OVER (PARTITION BY entity_type, lower(entity_name) ORDER BY event_seq, event_id) AS VARCHAR) AS n,
        CASE entity_type WHEN 'actor' THEN 'ACTS_IN' WHEN 'patient' THEN 'AFFECTED_IN' ELSE 'MOTIVATES' END FROM pr) WHERE n IS NOT NULL
    UNION ALL SELECT CAST(src AS VARCHAR), CAST(dst AS VARCHAR), 'FOLLOWS' FROM (SELECT id AS src, lead(id) OVER (ORDER BY seq) AS dst, chapter, lead(chapter) OVER (ORDER BY seq) AS c FROM ev) WHERE chapter = c
    UNION ALL SELECT CAST(src AS VARCHAR), CAST(dst AS VARCHAR), relation FROM lk
    UNION ALL SELECT CAST(a.id AS VARCHAR), CAST(b.id AS VARCHAR), 'CONTRAST' FROM ev a JOIN ev b ON b.id = a.id + 3""", "mb", "pr", "ev", "lk")
def chain_edges(spark, sf):
    ev, pr, mb = _graph_parts(spark, sf)
    semantic = ev.select(F.col("id").alias("src"), (F.col("id") + 3).alias("dst"), F.lit("contrast").alias("type"))
    return graph.chain_edges(ev, pr, mb, D.links(spark, ev), semantic)


@query("""SELECT ':ID' AS kind, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM ev UNION ALL SELECT 'INCLUDES', count(*), CAST(sum(id) AS BIGINT) FROM mb
    UNION ALL SELECT 'CAUSES', count(*), CAST(sum(src + dst) AS BIGINT) FROM lk""", "ev", "mb", "lk")
def csv_round_trip(spark, sf):
    """Events, members and links written as CSV tables and read again by name."""
    from .runtime import scratch

    ev, pr, mb = _graph_parts(spark, sf)
    text, none = ev.withColumns({"name": F.concat(F.lit('a "quoted", name\\n'), "event_type"), "action_type": F.col("event_type"), "quote": F.lit("x"), "confidence": F.lit(0.5), "scene": F.lit(""), "notes": F.lit("")}), F.lit(None).cast("string")
    links = D.links(spark, ev).withColumns({"mechanism": none, "weight": F.lit(0.5), "edge_supertype": none})
    table = mb.select("scene", "chapter").distinct().withColumns({"theme": F.lit("t"), "confidence": F.lit(0.9)})
    tables = W.csv_tables(text, pr.withColumn("entity_id", F.col("entity_name")), links, mb, table, follows(ev))
    where = scratch(spark, "csv")
    W.write_csv_tables({k: tables[k] for k in ("events", "scene_includes_event", "causes")}, where)
    back = lambda name: spark.read.csv(f"{where}/{name}.csv", header=True, escape='"', multiLine=True)
    total = lambda df, kind, c: df.agg(F.count("*").alias("n"), F.sum(c).cast("long").alias("total")).select(kind.alias("kind"), "n", "total")
    out = total(back("events"), F.lit(":ID"), F.col("sequence").cast("long"))
    out = out.unionByName(total(back("scene_includes_event"), F.lit("INCLUDES"), F.col("`:END_ID`").cast("long")))
    return out.unionByName(total(back("causes"), F.lit("CAUSES"), F.col("`:START_ID`").cast("long") + F.col("`:END_ID`").cast("long")))

"""All queries of the culling engine and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.functions import scalars as S
from lightsift.functions.vectors import cosine
from lightsift.operators import browse as B
from lightsift.operators import bursts as BU
from lightsift.operators import dedup as D
from lightsift.operators import learn as L
from lightsift.operators import picks as P
from lightsift.operators import quality as Q
from lightsift.operators import vector_index as VI
from lightsift.operators.downloads import archive_names
from lightsift.operators.search import search
from lightsift.sources import manifest as M
from lightsift.session import scratch, written
from lightsift.streaming import watch as W

from . import bindings as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ME, TOP, PAGE = "1", 40.0, 50


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- shared SQL -------------------------------------------------------------------------------
FRAMES = """frames AS MATERIALIZED (
    SELECT e.event_id AS path, e.user_id AS camera_id, e.ts AS captured_at, e.value AS score, v.embedding::DOUBLE[] AS emb,
           CASE WHEN (e.event_id % 13) / 100.0::DOUBLE >= 0.04 THEN 'people' ELSE 'stage' END AS subject_class,
           (e.event_id % 13) / 100.0::DOUBLE >= 0.06 AND e.event_id % 3 <= 1 AND (e.event_id % 5) / 100.0::DOUBLE < 0.02 AND (e.event_id % 7) / 100.0::DOUBLE <= 0.05 AS is_hero
    FROM events e JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) FROM embeddings))"""


def bursts_sql(rule: str) -> str:
    return f"""lagged AS (SELECT *, lag(captured_at) OVER c AS pt, lag(emb) OVER c AS pe FROM frames WINDOW c AS (PARTITION BY camera_id ORDER BY captured_at, path)),
    cuts AS (SELECT *, CASE WHEN pt IS NULL THEN 1 WHEN date_diff('microsecond', pt, captured_at) / 1e6 <= 1800 THEN 0 {rule} ELSE 1 END AS cut FROM lagged),
    bursts AS (SELECT * EXCLUDE (pt, pe, cut), CAST(sum(cut) OVER (ORDER BY camera_id, captured_at, path ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS burst_id FROM cuts)"""


BURSTS = bursts_sql("WHEN date_diff('microsecond', pt, captured_at) / 1e6 <= 14400 AND list_cosine_similarity(pe, emb) >= 0.15 THEN 0")
RANKED = """ranked0 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank, row_number() OVER (PARTITION BY burst_id ORDER BY score DESC, path) AS within_burst_rank,
        row_number() OVER (PARTITION BY burst_id ORDER BY score DESC, path) = 1 AS is_representative, count(*) OVER (PARTITION BY burst_id) AS burst_size FROM bursts),
    ranked AS (SELECT r.*, b.burst_rank FROM ranked0 r JOIN (SELECT burst_id, rank() OVER (ORDER BY score DESC) AS burst_rank FROM ranked0 WHERE is_representative) b USING (burst_id))"""
AXIS = """means AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings WHERE label IN (0, 1)) GROUP BY label, pos),
    protos AS (SELECT label, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12) AS x FROM means),
    axis AS (SELECT list(c.x - w.x ORDER BY c.pos) AS a FROM protos c JOIN protos w ON c.pos = w.pos AND c.label = 1 AND w.label = 0)"""
RUN = """run AS (SELECT *, CASE WHEN cl < -0.038 THEN 'wide' WHEN cl >= 0 THEN 'close' ELSE 'medium' END AS shot_type FROM (SELECT r.*, list_dot_product(r.emb, a) AS cl FROM ranked r, axis))"""
PICKS = """picks AS (SELECT DISTINCT o_orderkey % (SELECT count(*) FROM events) AS path, CAST(o_custkey % 5 AS VARCHAR) AS viewer FROM orders)"""
FLAGS = """flags AS (SELECT path, count(DISTINCT viewer) AS n_picks, bool_or(viewer = '1') AS mine, bool_or(viewer <> '1') AS others, string_agg(viewer, ',' ORDER BY viewer) AS owners FROM picks GROUP BY path)"""
ALL = f"WITH {FRAMES}, {BURSTS}, {RANKED}, {AXIS}, {RUN}, {PICKS}, {FLAGS}"
TECH = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_extendedprice / 5000 AS sharpness, l_discount AS face_frac, l_tax * 3 AS ear, l_quantity / 100 AS clipped,
        l_discount * 10 AS centeredness, l_returnflag = 'R' AS face_detected, l_extendedprice / l_quantity AS score_s1, l_discount AS area, l_linenumber AS n_prominent, l_tax AS second, l_quantity / 50 AS background FROM lineitem),
    e AS (SELECT quantile_cont(ln(1 + sharpness), 0.05) AS lo, quantile_cont(ln(1 + sharpness), 0.95) AS hi FROM q),
    t0 AS (SELECT q.*, greatest(least((ln(1 + sharpness) - lo) / (hi - lo), 1), 0) AS sharp, greatest(least(clipped / 0.30, 1), 0) AS exposure,
        (1 - greatest(least((ear - 0.10) / (0.22 - 0.10), 1), 0)) * greatest(least((face_frac - 0.005) / (0.05 - 0.005), 1), 0) AS eyes,
        0.5 * greatest(least(face_frac / 0.20, 1), 0) + 0.5 * centeredness AS composition FROM q, e),
    t AS (SELECT *, 0.4 * sharp - 0.4 * exposure - 0.5 * eyes + 0.2 * composition AS tech_score,
        CASE WHEN face_frac > 0.05 AND ear < 0.12 THEN 'eyes_closed' WHEN face_detected AND face_frac > 0.005 AND sharpness < 4 THEN 'severe_blur' WHEN face_detected AND clipped > 0.40 THEN 'exposure_clipped' ELSE '' END AS reason FROM t0)"""
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)


def r6(c: str, name: str | None = None) -> F.Column:
    return F.round(c, 6).alias(name or c)


# --- bursts and ranks -------------------------------------------------------------------------
@query("burst_ids", f"WITH {FRAMES}, {BURSTS} SELECT path, camera_id, burst_id FROM bursts")
def burst_ids(spark, d):
    return X.cut(spark, d).select("path", "camera_id", "burst_id")


@query("burst_time_only", f"WITH {FRAMES}, {bursts_sql('')} SELECT path, camera_id, burst_id FROM bursts")
def burst_time_only(spark, d):
    return BU.burst_ids(X.frames(spark, d), X.SHORT, similarity=False).select("path", "camera_id", "burst_id")


@query("burst_summary", f"WITH {FRAMES}, {BURSTS} SELECT count(*) AS n_bursts, count(*) FILTER (n > 1) AS n_multi, count(*) FILTER (n = 1) AS n_singleton FROM (SELECT burst_id, count(*) AS n FROM bursts GROUP BY burst_id)")
def burst_summary(spark, d):
    return BU.burst_summary(X.bursts(spark, d))


COLS = ["path", "score", "rank", "burst_id", "within_burst_rank", "is_representative", "burst_rank", "burst_size"]


@query("frames_ranked", f"WITH {FRAMES}, {BURSTS}, {RANKED} SELECT {', '.join(COLS)} FROM ranked")
def frames_ranked(spark, d):
    return X.run(spark, d).select(*COLS)


@query("burst_reps", f"WITH {FRAMES}, {BURSTS}, {RANKED} SELECT burst_id, path, score, burst_rank FROM ranked WHERE is_representative")
def burst_reps(spark, d):
    return X.run(spark, d).where("is_representative").select("burst_id", "path", "score", "burst_rank")


@query("bursts_table", f"{ALL} SELECT burst_rank, burst_id, burst_size, path, shot_type, subject_class, is_hero, score FROM run WHERE is_representative")
def bursts_table(spark, d):
    return X.run(spark, d).where("is_representative").select("burst_rank", "burst_id", "burst_size", "path", "shot_type", "subject_class", "is_hero", "score").orderBy("burst_rank", "path")


HOLES = "holes AS (SELECT * REPLACE (CASE WHEN path % 7 = 0 OR burst_id % 5 = 0 THEN NULL ELSE score END AS score) FROM bursts)"


@query("ranked_without_scores", f"""WITH {FRAMES}, {BURSTS}, {HOLES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, path) AS rank, rank() OVER (ORDER BY score DESC NULLS LAST) AS score_rank,
        row_number() OVER (PARTITION BY burst_id ORDER BY score DESC NULLS LAST, path) AS within_burst_rank, count(*) OVER (PARTITION BY burst_id) AS burst_size FROM holes),
    b AS (SELECT burst_id, rank() OVER (ORDER BY score DESC NULLS LAST) AS burst_rank FROM r WHERE within_burst_rank = 1)
    SELECT path, rank, score_rank, within_burst_rank, within_burst_rank = 1 AS is_representative, burst_size, burst_rank FROM r JOIN b USING (burst_id)""")
def ranked_without_scores(spark, d):
    """Frames and whole bursts without a score rank after all others; none is lost."""
    run = X.bursts(spark, d).select("path", "burst_id", F.when((F.col("path") % 7 != 0) & (F.col("burst_id") % 5 != 0), F.col("score")).alias("score"))
    return BU.ranked(run).select("path", "rank", "score_rank", "within_burst_rank", "is_representative", "burst_size", "burst_rank")


# --- pages ------------------------------------------------------------------------------------
PAGE_COLS = ["path", "score", "burst_id", "burst_rank", "within_burst_rank", "shot_type", "subject_class", "is_hero", "n_picks", "mine", "others", "owners"]
ORDER_SQL = {"rank": "score DESC, path", "time": "captured_at ASC NULLS LAST, within_burst_rank, rank", "stars": "n_picks DESC, score DESC, path"}


def page_sql(sort: str, unfurl: bool) -> str:
    rank = "rank() OVER (ORDER BY score DESC) AS burst_rank" if unfurl else "burst_rank"
    pick = "SELECT * FROM m" if unfurl else f"SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY burst_id ORDER BY {ORDER_SQL[sort]}) = 1"
    return f"""{ALL}, shown AS (SELECT * EXCLUDE (burst_rank), {rank} FROM run),
        m AS (SELECT s.*, coalesce(n_picks, 0) AS n_picks, coalesce(mine, false) AS mine, coalesce(others, false) AS others, coalesce(owners, '') AS owners
              FROM shown s LEFT JOIN flags f ON s.path = f.path WHERE s.score >= (SELECT quantile_cont(score, 0.6) FROM run) AND shot_type IN ('wide', 'close') AND subject_class = 'people'),
        c AS ({pick}) SELECT {', '.join(PAGE_COLS)} FROM c ORDER BY {ORDER_SQL[sort]} LIMIT {PAGE}"""


def page(sort: str, unfurl: bool) -> Query:
    q = B.BrowseQuery(shot="wide,close", subject="people", top_pct=TOP, sort=sort, unfurl=unfurl, viewer=ME, limit=PAGE)
    return lambda spark, d: q.page(X.run(spark, d), X.picks(spark, d), X.known(spark, d)).select(*PAGE_COLS)


for _sort in ORDER_SQL:
    for _unfurl in (False, True):
        query(f"browse_{_sort}" + "_unfurl" * _unfurl, page_sql(_sort, _unfurl))(page(_sort, _unfurl))


@query("hero_frames", f"{ALL} SELECT path, score, burst_id FROM run WHERE is_hero")
def hero_frames(spark, d):
    return B.BrowseQuery(hero=True).matching(X.run(spark, d)).select("path", "score", "burst_id")


@query("quality_cut", f"WITH {FRAMES} SELECT path, score FROM frames WHERE score >= (SELECT quantile_cont(score, 0.6) FROM frames)")
def quality_cut(spark, d):
    return B.quality_cut(X.frames(spark, d), TOP).select("path", "score")


@query("burst_detail_nonempty", f"WITH {FRAMES}, {BURSTS} SELECT path, burst_id FROM (SELECT *, score >= (SELECT quantile_cont(score, 0.8) FROM frames) AS ok FROM bursts) QUALIFY ok OR count(*) FILTER (ok) OVER (PARTITION BY burst_id) = 0")
def burst_detail_nonempty(spark, d):
    return B.burst_detail(X.bursts(spark, d), 20, known=X.known(spark, d)).select("path", "burst_id")


@query("run_stats", f"""{ALL}, cut AS (SELECT * FROM run WHERE score >= (SELECT quantile_cont(score, 0.6) FROM run)), vis AS (SELECT DISTINCT burst_id FROM cut WHERE shot_type = 'close')
    SELECT (SELECT count(*) FROM run) AS n_frames, (SELECT count(DISTINCT burst_id) FROM run) AS n_bursts, (SELECT count(DISTINCT burst_id) FROM run WHERE burst_size > 1) AS n_multi,
           (SELECT count(DISTINCT path) FROM picks) AS n_starred, (SELECT count(*) FROM cut SEMI JOIN vis USING (burst_id)) AS n_frames_shown""")
def run_stats(spark, d):
    return B.run_stats(X.run(spark, d), X.picks(spark, d), B.BrowseQuery(shot="close", top_pct=TOP), X.known(spark, d))


# --- picks ------------------------------------------------------------------------------------
@query("picks_flags", f"WITH {PICKS}, {FLAGS} SELECT * FROM flags")
def picks_flags(spark, d):
    return P.per_frame(X.picks(spark, d), ME)


@query("picks_per_burst", f"WITH {FRAMES}, {BURSTS}, {PICKS} SELECT burst_id, count(*) AS n_picked FROM bursts SEMI JOIN picks USING (path) GROUP BY burst_id")
def picks_per_burst(spark, d):
    return P.picked_per_burst(X.bursts(spark, d), X.picks(spark, d))


def starred_sql(where: str) -> str:
    return f"{ALL} SELECT r.path, burst_rank, within_burst_rank, n_picks, mine, others FROM run r JOIN flags f ON r.path = f.path WHERE {where}"


for _owner, _where in (("mine", "mine"), ("others", "others"), ("all", "true")):
    query(f"starred_{_owner}", starred_sql(_where))(lambda spark, d, o=_owner: P.starred(X.run(spark, d), X.picks(spark, d), o, ME, "stars").select("path", "burst_rank", "within_burst_rank", "n_picks", "mine", "others"))


@query("clear_mine", f"WITH {PICKS} SELECT * FROM picks WHERE viewer <> '1'")
def clear_mine(spark, d):
    return P.cleared(X.picks(spark, d), ME)


LOG = "SELECT l_orderkey % 500 AS path, CAST(l_suppkey % 5 AS VARCHAR) AS viewer, l_returnflag <> 'R' AS wanted, l_shipdate AS ts, l_extendedprice + l_quantity / 1000 + l_linenumber / 1e6 + l_partkey / 1e10 AS seq FROM lineitem"


@query("picks_replay", f"SELECT path, viewer FROM (SELECT * FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY path, viewer ORDER BY ts DESC, seq DESC) = 1) WHERE wanted")
def picks_replay(spark, d):
    c = F.col
    seq = c("l_extendedprice") + c("l_quantity") / 1000 + c("l_linenumber") / 1e6 + c("l_partkey") / 1e10
    log = X.table(spark, d, "lineitem").select((c("l_orderkey") % 500).alias("path"), (c("l_suppkey") % 5).cast("string").alias("viewer"), (c("l_returnflag") != "R").alias("wanted"), c("l_shipdate").alias("ts"), seq.alias("seq"))
    return P.replayed(log)


@query("viewer_names", f"WITH {PICKS}, n AS (SELECT CAST(n_nationkey AS VARCHAR) AS viewer, CASE WHEN n_nationkey % 2 = 0 THEN '  ' || n_name || ' ' ELSE '' END AS name FROM nation) SELECT v.viewer, coalesce(nullif(substr(trim(name), 1, 40), ''), v.viewer) AS name FROM (SELECT DISTINCT viewer FROM picks) v LEFT JOIN n ON v.viewer = n.viewer")
def viewer_names(spark, d):
    names = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("viewer"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  "), "n_name", F.lit(" "))).otherwise("").alias("name"))
    return P.named(X.picks(spark, d).select("viewer").distinct(), names)


# --- search -----------------------------------------------------------------------------------
SEARCH = f"{ALL}, s AS (SELECT r.*, list_dot_product(r.emb, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS sim FROM run r)"


def query_vector(spark, d):
    return X.table(spark, d, "embeddings").where("vec_id = 7").select(F.col("embedding").cast("array<double>").alias("q"))


@query("search_topk", f"{SEARCH} SELECT path, burst_id, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, path LIMIT 50")
def search_topk(spark, d):
    return search(X.run(spark, d), query_vector(spark, d)).select("path", "burst_id", r6("similarity"))


BEST_HIT = "SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY burst_id ORDER BY sim DESC, path) = 1"


KNN = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS key, list_cosine_similarity(a.v, b.v) AS sim FROM e a, e b WHERE a.vec_id % 100 = 0)
    SELECT query, key, round(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, key) AS INTEGER) AS rank FROM p QUALIFY rank <= 10"""


def neighbours(spark, d, recall):
    """The ten rows nearest to every row whose id is divisible by 100, from an index of all embeddings."""
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("emb"))
    root = scratch("vectors", spark)
    VI.build(spark, root, e)
    asked = e.where(F.col("key") % 100 == 0).select(F.col("key").alias("query"), F.col("emb").alias("q"))
    return VI.nearest(spark, root, asked, 10, recall).select("query", "key", r6("similarity"), "rank")


@query("nearest_exact", KNN)
def nearest_exact(spark, d):
    return neighbours(spark, d, None)


@query("nearest_probed")
def nearest_probed(spark, d):
    """Reads as many of a query's nearest lists as a recall of 0.98 took when the index was built; tests hold it against all rows."""
    return neighbours(spark, d, VI.RECALL)


@query("search_grouped", f"{SEARCH} SELECT path, burst_id, round(sim, 6) AS similarity FROM ({BEST_HIT}) ORDER BY sim DESC, path LIMIT 50")
def search_grouped(spark, d):
    return search(X.run(spark, d), query_vector(spark, d), grouped=True).select("path", "burst_id", r6("similarity"))


@query("search_starred", f"{SEARCH} SELECT path, burst_id, round(sim, 6) AS similarity FROM ({BEST_HIT}) WHERE burst_id IN (SELECT burst_id FROM run SEMI JOIN picks USING (path)) ORDER BY sim DESC, path LIMIT 50")
def search_starred(spark, d):
    return search(X.run(spark, d), query_vector(spark, d), grouped=True, picks=X.picks(spark, d)).select("path", "burst_id", r6("similarity"))


# --- tags and quality -------------------------------------------------------------------------
@query("shot_tags", f"WITH {AXIS}, c AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], a) AS cl FROM embeddings, axis) SELECT vec_id, round(cl, 6) AS shot_closeness, CASE WHEN cl < -0.038 THEN 'wide' WHEN cl >= 0 THEN 'close' ELSE 'medium' END AS shot_type FROM c")
def shot_tags(spark, d):
    v = X.table(spark, d, "embeddings").withColumnRenamed("embedding", "emb")
    return Q.shot_tags(v, *X.prototypes(spark, d)).select("vec_id", r6("shot_closeness"), "shot_type")


@query("scene_tags", f"WITH {TECH} SELECT {LINE_SQL}, CASE WHEN area >= 0.04 THEN 'people' ELSE 'stage' END AS subject_class, area >= 0.06 AND n_prominent <= 1 AND second < 0.02 AND background <= 0.5 AS is_hero FROM q")
def scene_tags(spark, d):
    c = F.col
    return X.quality_rows(spark, d).select(*LINE, S.subject_of(c("area")).alias("subject_class"), S.hero_of(c("area"), c("n_prominent"), c("second"), c("background"), X.HERO_BACKGROUND).alias("is_hero"))


@query("box_summary", "SELECT l_orderkey, max(l_discount) AS area, coalesce((list(l_discount ORDER BY l_discount DESC))[2], 0) AS second, count(*) FILTER (l_discount >= 0.02) AS n_prominent FROM lineitem GROUP BY l_orderkey")
def box_summary(spark, d):
    images = X.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("areas"))
    return Q.box_summary(images).drop("areas")


@query("tech_scores", f"WITH {TECH} SELECT {LINE_SQL}, round(sharp, 6) AS tech_sharpness_norm, round(exposure, 6) AS tech_exposure_penalty, round(eyes, 6) AS tech_eye_open_penalty, round(composition, 6) AS tech_composition_bonus, round(tech_score, 6) AS tech_score FROM t")
def tech_scores(spark, d):
    return Q.tech_scores(X.quality_rows(spark, d)).select(*LINE, *[r6(c) for c in ("tech_sharpness_norm", "tech_exposure_penalty", "tech_eye_open_penalty", "tech_composition_bonus", "tech_score")])


@query("hard_rejects", f"WITH {TECH} SELECT {LINE_SQL}, reason AS tech_hard_reject_reason, reason <> '' AS tech_hard_reject FROM t")
def hard_rejects(spark, d):
    return Q.hard_rejects(X.quality_rows(spark, d), enabled=True).select(*LINE, "tech_hard_reject_reason", "tech_hard_reject")


@query("stage_combine", f"""WITH {TECH}, m AS (SELECT avg(score_s1) AS m1, stddev_pop(score_s1) AS s1, avg(tech_score) AS m2, stddev_pop(tech_score) AS s2 FROM t),
    z AS (SELECT t.*, (score_s1 - m1) / s1 + 0.3 * (tech_score - m2) / s2 AS zz FROM t, m)
    SELECT {LINE_SQL}, round(zz, 6) AS score_s12, round(CASE WHEN reason <> '' THEN -1e9 ELSE zz END, 6) AS score_s3_final FROM z""")
def stage_combine(spark, d):
    out = Q.stage_combine(Q.hard_rejects(Q.tech_scores(X.quality_rows(spark, d)), enabled=True), alpha=0.3)
    return out.select(*LINE, r6("score_s12"), r6("score_s3_final"))


# --- dedup ------------------------------------------------------------------------------------
@query("exact_dedup", "SELECT min(doc_id) AS doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents GROUP BY ALL")
def exact_dedup(spark, d):
    files = X.table(spark, d, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha1"))
    return D.first_of_content(files, "sha1", [F.asc("doc_id")])


EDGES = "edges AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35)"


def edges(spark, d):
    return D.alike_edges(X.table(spark, d, "embeddings"), "vec_id", "embedding", X.NEAR)


@query("near_dup_edges", f"WITH {EDGES} SELECT a, b FROM edges")
def near_dup_edges(spark, d):
    return edges(spark, d).select("a", "b")


@query("near_dup_greedy", f"""WITH RECURSIVE {EDGES}, nb AS MATERIALIZED (SELECT v.vec_id AS i, coalesce(list(a) FILTER (a IS NOT NULL), []) AS ns FROM embeddings v LEFT JOIN edges ON b = v.vec_id GROUP BY v.vec_id),
    walk(i, kept) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT nb.i, CASE WHEN list_has_any(w.kept, nb.ns) THEN w.kept ELSE list_append(w.kept, nb.i) END FROM walk w JOIN nb ON nb.i = w.i + 1)
    SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)""")
def near_dup_greedy(spark, d):
    return D.greedy_alike(X.table(spark, d, "embeddings"), "vec_id", "embedding", X.NEAR)


NUDGED = """nudged AS MATERIALIZED (SELECT 2 * vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings
    UNION ALL SELECT 2 * vec_id + 1, list_prepend(embedding[1]::DOUBLE + 0.002::DOUBLE * (vec_id % 40), embedding[2:]::DOUBLE[]) FROM embeddings),
    tight AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM nudged a JOIN nudged b ON a.k < b.k AND list_cosine_similarity(a.v, b.v) >= 0.9995)"""


def nudged(spark, d):
    """The given vectors and a slightly changed one of each."""
    v = X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    other = F.transform("v", lambda x, i: x + F.when(i == 0, 0.002 * (F.col("vec_id") % 40)).otherwise(0.0))
    return v.select((2 * F.col("vec_id")).alias("k"), "v").unionByName(v.select((2 * F.col("vec_id") + 1).alias("k"), other.alias("v")))


@query("look_alikes", f"WITH {NUDGED} SELECT a, b FROM tight")
def look_alikes(spark, d):
    return D.alike_edges(nudged(spark, d), "k", "v", D.ALIKE, recall=0.9999).select("a", "b")


@query("look_alikes_kept", f"""WITH RECURSIVE {NUDGED}, nb AS MATERIALIZED (SELECT b AS k, list(a) AS ns, row_number() OVER (ORDER BY b) AS i FROM tight GROUP BY b),
    walk(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT nb.i, CASE WHEN len([x FOR x IN nb.ns IF NOT list_contains(walk.gone, x)]) > 0 THEN list_append(walk.gone, nb.k) ELSE walk.gone END FROM walk JOIN nb ON nb.i = walk.i + 1)
    SELECT k FROM nudged WHERE k NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1))""")
def look_alikes_kept(spark, d):
    v = nudged(spark, d)
    return D.greedy(v, "k", written(D.alike_edges(v, "k", "v", D.ALIKE, recall=0.9999)))


@query("train_dedup", "SELECT sha1(d.text) AS sha1, min(d.doc_id) AS path, max(quality) AS y FROM documents d JOIN labels USING (doc_id) GROUP BY ALL")
def train_dedup(spark, d):
    rows = X.table(spark, d, "documents").join(X.table(spark, d, "labels"), "doc_id").select(F.sha1(F.col("text").cast("binary")).alias("sha1"), F.col("doc_id").alias("path"), F.col("quality").alias("y"))
    return D.training_rows(rows, "sha1", "path", "y")


FILES = "files AS (SELECT doc_id, lang AS dir, doc_id // 4 AS stem, CASE WHEN doc_id % 2 = 1 THEN 'jpg' ELSE 'cr3' END AS ext FROM documents)"


@query("raw_jpeg_pairs", f"WITH {FILES} SELECT * FROM files f WHERE ext = 'jpg' OR NOT EXISTS (SELECT 1 FROM files g WHERE g.ext = 'jpg' AND g.dir = f.dir AND g.stem = f.stem)")
def raw_jpeg_pairs(spark, d):
    files = X.table(spark, d, "documents").select("doc_id", F.col("lang").alias("dir"), F.floor(F.col("doc_id") / 4).alias("stem"), F.when(F.col("doc_id") % 2 == 1, "jpg").otherwise("cr3").alias("ext"))
    return D.without_paired_raw(files).select("doc_id", "dir", "stem", "ext")


# --- metadata ---------------------------------------------------------------------------------
@query("camera_identity", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' S' || c_custkey || ' ' END AS serial, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS make, CASE WHEN c_custkey % 5 <> 0 THEN 'M' || c_custkey % 10 ELSE '  ' END AS model, CASE WHEN c_custkey % 2 = 0 THEN 'L1' END AS lens, 'f' || c_custkey AS filename FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, CASE WHEN nullif(trim(serial), '') IS NOT NULL THEN 'body:' || trim(serial) WHEN make IS NOT NULL AND nullif(trim(model), '') IS NOT NULL AND lens IS NOT NULL THEN 'rig:' || trim(make) || '/' || trim(model) || '/' || lens WHEN make IS NOT NULL AND nullif(trim(model), '') IS NOT NULL THEN 'model:' || trim(make) || '/' || trim(model) ELSE 'unknown:' || filename END AS camera FROM c""")
def camera_identity(spark, d):
    c = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    return c.select("c_custkey", S.camera_of(F.when(k % 3 == 0, F.concat(F.lit(" S"), text, F.lit(" "))), F.when(k % 7 != 0, F.col("n_name")), F.when(k % 5 != 0, F.concat(F.lit("M"), (k % 10).cast("string"))).otherwise("  "), F.when(k % 2 == 0, "L1"), F.concat(F.lit("f"), text)).alias("camera"))


@query("exif_parse", "SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN date_trunc('second', ts) + to_microseconds(CAST(rpad(substr(CAST(event_id AS VARCHAR), 1, 6), 6, '0') AS BIGINT)) END AS taken FROM events")
def exif_parse(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", S.capture_time(F.when(F.col("event_id") % 17 != 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise("not a date"), F.concat(F.col("event_id").cast("string"), F.lit("x"))).alias("taken"))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def iso_times(spark, d):
    return X.table(spark, d, "events").select("event_id", S.iso_time(F.col("ts")).alias("iso"))


@query("safe_names", r"SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'run') AS name, printf('run%04d_%s', page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'run')) AS folder FROM pages")
def safe_names(spark, d):
    return X.table(spark, d, "pages").select("page_id", S.safe_name(F.col("url")).alias("name"), S.folder_name(F.col("page_id"), F.col("url")).alias("folder"))


@query("zip_names", "SELECT doc_id, CASE WHEN n = 1 THEN source || '.txt' ELSE source || '_' || n || '.txt' END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def zip_names(spark, d):
    files = X.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("name"))
    return archive_names(files, written, order="doc_id").select("doc_id", F.col("archived").alias("name"))


# --- incremental arrival ----------------------------------------------------------------------
def files_of(spark, d):
    c = F.col
    return X.table(spark, d, "documents").select(c("doc_id").alias("path"), c("n_chars").alias("size"), (c("doc_id") * 7).alias("mtime"))


def old_manifest(spark, d):
    """The listing before: every fifth file unknown, every seventh of another size, and some that are gone since."""
    c = F.col
    f = files_of(spark, d).where("path % 5 <> 0").withColumn("size", F.when(c("path") % 7 == 0, c("size") + 1).otherwise(c("size")))
    return f.unionByName(files_of(spark, d).where("path % 11 = 0").withColumn("path", c("path") + 1000000000)).withColumn("sha1", F.sha1(c("path").cast("string").cast("binary")))


OLD = "files AS (SELECT doc_id AS path, n_chars AS size, doc_id * 7 AS mtime FROM documents), old AS (SELECT path, CASE WHEN path % 7 = 0 THEN size + 1 ELSE size END AS size, mtime FROM files WHERE path % 5 <> 0 UNION ALL SELECT path + 1000000000, size, mtime FROM files WHERE path % 11 = 0)"


@query("changed_files", f"WITH {OLD} SELECT * FROM files ANTI JOIN old USING (path, size, mtime)")
def changed_files(spark, d):
    return M.changed(files_of(spark, d), old_manifest(spark, d))


@query("vanished_files", f"WITH {OLD} SELECT path FROM old ANTI JOIN files USING (path)")
def vanished_files(spark, d):
    return M.vanished(old_manifest(spark, d), files_of(spark, d)).select("path")


@query("cache_misses", "SELECT DISTINCT sha1(d.text) AS sha1 FROM documents d WHERE sha1(d.text) NOT IN (SELECT sha1(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def cache_misses(spark, d):
    docs = X.table(spark, d, "documents").select("lang", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.lit("context").alias("kind"), F.lit("stub").alias("encoder_id"))
    return M.misses(docs, docs.where("lang = 'en'")).select("sha1").distinct()


# --- learning ---------------------------------------------------------------------------------
@query("auc_quality", """WITH d AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d)
    SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM r""")
def auc_quality(spark, d):
    rows = X.table(spark, d, "labels").join(X.table(spark, d, "documents"), "doc_id")
    return L.auc(rows, "n_chars", "quality").withColumn("auc", F.round("auc", 9))


@query("stratified_folds", "SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold FROM labels")
def stratified_folds(spark, d):
    return L.stratified_folds(X.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


LABELLED = f"{FRAMES}, {BURSTS}, lb AS (SELECT path, burst_id, CASE WHEN score >= 50 THEN 1 ELSE 0 END AS y FROM bursts)"


def labelled(spark, d):
    return X.bursts(spark, d).withColumn("y", F.when(F.col("score") >= 50, 1).otherwise(0))


@query("mixed_bursts", f"WITH {LABELLED} SELECT burst_id, count(*) FILTER (y = 1) AS n_good, count(*) FILTER (y = 0) AS n_bad FROM lb GROUP BY burst_id HAVING n_good > 0 AND n_bad > 0")
def mixed_bursts(spark, d):
    return L.mixed_bursts(labelled(spark, d), "y")


@query("within_burst_pairs", f"""WITH {LABELLED}, mixed AS (SELECT burst_id, count(*) FILTER (y = 1) AS n_good, count(*) FILTER (y = 0) AS n_bad FROM lb GROUP BY burst_id HAVING n_good > 0 AND n_bad > 0),
    places AS (SELECT *, row_number() OVER (ORDER BY burst_id) AS i, count(*) OVER () AS n FROM mixed), members AS (SELECT *, row_number() OVER (PARTITION BY burst_id, y ORDER BY path) AS r FROM lb),
    slots AS (SELECT slot, CAST('0x' || substr(md5('42:burst:' || slot), 1, 15) AS BIGINT) AS b, CAST('0x' || substr(md5('42:good:' || slot), 1, 15) AS BIGINT) AS g, CAST('0x' || substr(md5('42:bad:' || slot), 1, 15) AS BIGINT) AS w FROM (SELECT unnest(range(0, 4096)) AS slot))
    SELECT slot, p.burst_id, x.path AS good, z.path AS bad FROM slots s JOIN places p ON p.i = s.b % p.n + 1 JOIN members x ON x.burst_id = p.burst_id AND x.y = 1 AND x.r = s.g % n_good + 1 JOIN members z ON z.burst_id = p.burst_id AND z.y = 0 AND z.r = s.w % n_bad + 1""")
def within_burst_pairs(spark, d):
    return L.within_burst_pairs(labelled(spark, d), "y", 4096)


@query("random_pairs", f"""WITH {LABELLED}, g AS (SELECT path, row_number() OVER (ORDER BY path) AS i, count(*) OVER () AS n FROM lb WHERE y = 1), b AS (SELECT path, row_number() OVER (ORDER BY path) AS i, count(*) OVER () AS n FROM lb WHERE y = 0),
    slots AS (SELECT slot, CAST('0x' || substr(md5('42:good:' || slot), 1, 15) AS BIGINT) AS x, CAST('0x' || substr(md5('42:bad:' || slot), 1, 15) AS BIGINT) AS z FROM (SELECT unnest(range(0, 4096)) AS slot))
    SELECT slot, g.path AS good, b.path AS bad FROM slots JOIN g ON g.i = x % g.n + 1 JOIN b ON b.i = z % b.n + 1""")
def random_pairs(spark, d):
    return L.sampled_pairs(labelled(spark, d), "y", 4096)


def labelled_vectors(spark, d):
    """The given embeddings as features; a label below 5 is good, one of 9 must be found, and runs of eight are a burst."""
    c = F.col
    return X.table(spark, d, "embeddings").select(c("vec_id").alias("path"), c("embedding").cast("array<double>").alias("x"), F.when((c("label") < 5) | (c("label") == 9), 1).otherwise(0).alias("y"), (c("label") == 9).alias("must_find"), F.floor(c("vec_id") / 8).alias("burst_id"))


@query("ranknet_scores")
def ranknet_scores(spark, d):
    """The network, fitted on 4,096 new pairs of the given embeddings in each of 60 epochs, scored on all of them."""
    v = labelled_vectors(spark, d)
    pairs = L.with_vectors(L.training_pairs(v, "y", within=0.3, must_find=0.1, epochs=L.EPOCHS), v, "x").withColumn("by", F.lit(0))
    layers = L.fit_networks(pairs)[0].layers
    return L.score_mlp(v, "x", layers, ["path", "y"])


@query("linear_ranker_scores")
def linear_ranker_scores(spark, d):
    """The linear pairwise ranker, whose gradients are summed by the cluster, on the same embeddings."""
    v = labelled_vectors(spark, d)
    diff = L.with_vectors(L.sampled_pairs(v, "y", 2000), v, "x").select(F.zip_with("good_x", "bad_x", lambda a, b: a - b).alias("d"))
    w = L.fit_ranker(diff, 64)
    return v.select("path", "y", F.aggregate(F.zip_with("x", F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))


@query("ranknet_cv")
def ranknet_cv(spark, d):
    """AUC of each fold, their mean, and of the held-out, training and all rows."""
    return L.cross_validate(labelled_vectors(spark, d), "y", "x", n_pairs=1024, within=0.3, must_find=0.1)[0]


@query("holdout_split", "SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('holdout' || doc_id), doc_id) <= CASE WHEN count(*) OVER c >= 2 THEN least(greatest(1, round(count(*) OVER c * 0.2)), count(*) OVER c - 1) ELSE 0 END AS held_out FROM labels WINDOW c AS (PARTITION BY quality)")
def holdout_split(spark, d):
    return L.holdout(X.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("pair_losses", "SELECT l_orderkey, l_linenumber, round(greatest(-d, 0) + ln(1 + exp(-abs(d))), 6) AS softplus, round(greatest(1 - d, 0), 6) AS hinge FROM (SELECT *, l_discount * 20 - l_tax * 20 AS d FROM lineitem)")
def pair_losses(spark, d):
    x = F.col("l_discount") * 20 - F.col("l_tax") * 20
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.pair_loss(x), 6).alias("softplus"), F.round(S.pair_loss(x, 1.0), 6).alias("hinge"))


# --- streams ----------------------------------------------------------------------------------
LISTINGS = "ls AS (SELECT t.tick, doc_id AS path, n_chars + CASE WHEN doc_id % 4 = 0 THEN least(t.tick, 2) ELSE 0 END AS size, doc_id AS mtime FROM documents, (SELECT unnest(range(0, 5)) AS tick) t WHERE NOT (doc_id % 9 = 0 AND t.tick > 3) AND doc_id % 3 <= t.tick)"


@query("watch_manifest", f"""WITH {LISTINGS}, n AS (SELECT *, CASE WHEN lag(size) OVER w IS DISTINCT FROM size OR lag(mtime) OVER w IS DISTINCT FROM mtime OR lag(tick) OVER w IS DISTINCT FROM tick - 1 THEN tick END AS fresh FROM ls WINDOW w AS (PARTITION BY path ORDER BY tick)),
    s AS (SELECT *, max(fresh) OVER (PARTITION BY path ORDER BY tick) AS since FROM n), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY tick DESC) = 1)
    SELECT path, size, mtime, tick - since AS unchanged, tick - since >= 2 AND tick = 4 AS ready, tick < 4 AS gone FROM l""")
def watch_manifest(spark, d):
    c = F.col
    docs = X.table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("tick"))
    ls = docs.where(~((c("doc_id") % 9 == 0) & (c("tick") > 3)) & (c("doc_id") % 3 <= c("tick")))
    return W.manifest(ls.select("tick", c("doc_id").alias("path"), (c("n_chars") + F.when(c("doc_id") % 4 == 0, F.least("tick", F.lit(2).cast("long"))).otherwise(0)).alias("size"), c("doc_id").alias("mtime")))


@query("stream_session_bursts", """WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 1800000000 THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id AS camera_id, min(ts) AS first_at, count(*) AS n_frames FROM s GROUP BY user_id, n""")
def stream_session_bursts(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("camera_id"), F.col("ts").alias("captured_at"))
    return W.session_bursts(e, "1800 seconds").withColumn("first_at", F.col("first_at").cast("timestamp_ntz"))

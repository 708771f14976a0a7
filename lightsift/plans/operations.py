"""Queries of the registry, downloads, stored features, measurements and the watched folder; registered like all others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lightsift.functions import face as G
from lightsift.operators import browse as B
from lightsift.operators import downloads as DL
from lightsift.operators import incremental as I
from lightsift.operators import picks as P
from lightsift.operators import runs as R
from lightsift.session import written
from lightsift.sources import features as FE
from lightsift.streaming import watch as W

from . import bindings as X
from .registry import ALL, BURSTS, COLS, FRAMES, LISTINGS, ME, OLD, ORACLES, PICKS, QUERIES, RANKED, files_of, old_manifest, query

__all__ = ["ORACLES", "QUERIES"]

# --- registry of runs -------------------------------------------------------------------------
RUNS = """log AS (SELECT o_custkey AS run_id, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 'create' WHEN o_orderkey % 23 = 1 THEN 'delete' ELSE 'update' END AS op,
        CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey % 100 END AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'run' || o_custkey END AS folder, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'queued' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 END AS n_images FROM orders),
    born AS (SELECT * FROM (SELECT *, max(seq) FILTER (op = 'create') OVER (PARTITION BY run_id) AS b FROM log) WHERE seq >= b),
    runs AS (SELECT run_id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(folder, seq) FILTER (folder IS NOT NULL) AS folder, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(n_images, seq) FILTER (n_images IS NOT NULL) AS n_images FROM born GROUP BY run_id HAVING NOT bool_or(op = 'delete'))"""


def runs(spark, d):
    c = F.col
    k = c("o_orderkey")
    op = F.when(k % 7 == 0, "create").when(k % 23 == 1, "delete").otherwise("update")
    o = X.table(spark, d, "orders").select(c("o_custkey").alias("run_id"), k.alias("seq"), op.alias("op"), F.when(k % 2 == 0, F.concat(F.lit("n"), (k % 100).cast("string"))).alias("name"), F.when(k % 7 == 0, F.concat(F.lit("run"), c("o_custkey").cast("string"))).alias("folder"), F.when(c("o_orderstatus") == "F", "ready").when(c("o_orderstatus") == "O", "queued").alias("status"), F.when(k % 3 == 0, k % 1000).alias("n_images"))
    return R.current(o.withColumns({"created_at": F.lit(None).cast("timestamp_ntz"), "message": F.lit(None).cast("string")}))


@query("run_list", f"WITH {RUNS} SELECT run_id, name, folder, status, n_images FROM runs WHERE status = 'ready'")
def run_list(spark, d):
    return R.listed(runs(spark, d), ready_only=True).select("run_id", "name", "folder", "status", "n_images")


@query("default_run", f"WITH {RUNS} SELECT run_id, folder FROM runs WHERE status = 'ready' ORDER BY run_id DESC LIMIT 1")
def default_run(spark, d):
    return R.default_run(runs(spark, d)).select("run_id", "folder")


@query("delete_preview", f"""WITH {RUNS}, files AS (SELECT 'run' || l_suppkey AS folder, l_linenumber <= 2 AS upload, CAST(l_quantity AS BIGINT) * 1000 AS size FROM lineitem),
    sums AS (SELECT folder, count(*) FILTER (upload) AS n_originals, CAST(coalesce(sum(size) FILTER (upload), 0) AS BIGINT) AS originals_bytes, CAST(sum(size) AS BIGINT) AS total_bytes FROM files GROUP BY folder)
    SELECT run_id, name, status, n_images, s.folder IS NOT NULL AS exists, coalesce(n_originals, 0) AS n_originals, coalesce(originals_bytes, 0) AS originals_bytes, coalesce(total_bytes, 0) AS total_bytes, coalesce(n_originals, 0) > 0 AS holds_originals, run_id IN (7, 8) AS busy
    FROM runs LEFT JOIN sums s ON runs.folder = s.folder""")
def delete_preview(spark, d):
    c = F.col
    files = X.table(spark, d, "lineitem").select(F.concat(F.lit("run"), c("l_suppkey").cast("string")).alias("folder"), F.concat(F.lit("/r/"), F.when(c("l_linenumber") <= 2, "uploads/").otherwise("out/"), c("l_orderkey").cast("string")).alias("path"), (c("l_quantity").cast("long") * 1000).alias("size"))
    return R.delete_preview(runs(spark, d), files, busy=[7, 8])


@query("delete_guards", f"WITH {RUNS}, f AS (SELECT run_id, CASE run_id % 5 WHEN 0 THEN '../' || folder WHEN 1 THEN '' WHEN 2 THEN '/etc' ELSE folder END AS folder FROM runs) SELECT run_id, CASE WHEN run_id IN (7, 8) THEN 'busy' WHEN folder = '' THEN 'no_folder' WHEN run_id % 5 IN (0, 2) THEN 'outside' END AS refusal FROM f")
def delete_guards(spark, d):
    k = F.col("run_id") % 5
    folder = F.when(k == 0, F.concat(F.lit("../"), "folder")).when(k == 1, "").when(k == 2, "/etc").otherwise(F.col("folder"))
    return R.may_delete(runs(spark, d).withColumn("folder", folder), "/data/runs", busy=[7, 8]).select("run_id", "refusal")


# --- downloads --------------------------------------------------------------------------------
@query("allowed_paths", "SELECT doc_id, doc_id % 4 <> 3 AND doc_id IN (SELECT event_id FROM events WHERE event_id % 2 = 0) AS allowed FROM documents")
def allowed_paths(spark, d):
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/p/./"), i)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/p/q/../"), i)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("//p/"), i)).otherwise(F.concat(F.lit("/p/../"), i))
    frames = X.table(spark, d, "events").where("event_id % 2 = 0").select(F.concat(F.lit("/p/"), F.col("event_id").cast("string")).alias("path"))
    return DL.allowed(X.table(spark, d, "documents").select("doc_id", path.alias("path")), frames).select("doc_id", "allowed")


CHOSEN = """w AS (SELECT l_partkey AS path, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY l_partkey),
    s AS (SELECT w.path, pos, size, size IS NULL AS missing FROM w SEMI JOIN (SELECT p_partkey AS path FROM part WHERE p_partkey % 3 <> 0) k USING (path) LEFT JOIN (SELECT p_partkey AS path, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 10 <> 0) f ON w.path = f.path)"""


def chosen(spark, d):
    c = F.col
    wanted = X.table(spark, d, "lineitem").select(c("l_partkey").alias("path"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("pos"))
    parts = X.table(spark, d, "part").select(c("p_partkey").alias("path"), c("p_size").cast("long").alias("size"))
    return DL.selection(wanted, parts.where("path % 3 <> 0"), parts.where("path % 10 <> 0"))


@query("download_selection", f"WITH {CHOSEN} SELECT path, pos, size, missing FROM s")
def download_selection(spark, d):
    return chosen(spark, d).select("path", "pos", "size", "missing")


@query("download_total", f"WITH {CHOSEN} SELECT count(*) FILTER (NOT missing) AS count, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (missing) AS missing FROM s")
def download_total(spark, d):
    return DL.selection_total(chosen(spark, d))


@query("burst_detail_time", f"{ALL}, k AS (SELECT *, score >= (SELECT quantile_cont(score, 0.8) FROM run) AS ok FROM run), v AS (SELECT * FROM k QUALIFY ok OR count(*) FILTER (ok) OVER (PARTITION BY burst_id) = 0) SELECT burst_id, path, row_number() OVER (PARTITION BY burst_id ORDER BY captured_at NULLS LAST, within_burst_rank, path) AS pos FROM v")
def burst_detail_time(spark, d):
    run = X.run(spark, d)
    pos = F.row_number().over(Window.partitionBy("burst_id").orderBy(*B.detail_order(run, "time"))).cast("long")
    return B.burst_detail(run, 20, sort="time", known=X.known(spark, d)).select("burst_id", "path", pos.alias("pos"))


@query("starred_by_time", f"{ALL} SELECT r.path, burst_rank, n_picks, mine FROM run r JOIN flags f ON r.path = f.path WHERE mine")
def starred_by_time(spark, d):
    return P.starred(X.run(spark, d), X.picks(spark, d), "mine", ME, "time").select("path", "burst_rank", "n_picks", "mine")


@query("starred_filtered", f"{ALL} SELECT r.path, burst_rank, within_burst_rank, n_picks FROM run r JOIN flags f ON r.path = f.path WHERE mine AND shot_type IN ('wide', 'close') AND subject_class = 'people' AND score IS NOT NULL")
def starred_filtered(spark, d):
    """My picks among close and wide shots of people, in the default order; no quality cut applies."""
    only = B.BrowseQuery(shot="wide,close", subject="people").matching
    return P.starred(X.run(spark, d), X.picks(spark, d), "mine", ME, matching=only).select("path", "burst_rank", "within_burst_rank", "n_picks")


WISHES = "w AS (SELECT o_orderkey % (2 * (SELECT count(*) FROM events)) AS path, CAST(o_custkey % 5 AS VARCHAR) AS viewer, o_orderkey % 3 <> 0 AS wanted, o_orderkey AS seq FROM orders)"


@query("picks_accepted", f"WITH {WISHES} SELECT path, viewer, wanted, seq, path IN (SELECT event_id FROM events) AS ok FROM w")
def picks_accepted(spark, d):
    n = X.table(spark, d, "events").agg((2 * F.count(F.lit(1))).alias("n"))  # one row
    o = X.table(spark, d, "orders").crossJoin(F.broadcast(n))
    wishes = o.select((F.col("o_orderkey") % F.col("n")).alias("path"), (F.col("o_custkey") % 5).cast("string").alias("viewer"), (F.col("o_orderkey") % 3 != 0).alias("wanted"), F.col("o_orderkey").alias("seq"))
    return P.accepted(wishes, X.table(spark, d, "events").select(F.col("event_id").alias("path")))


@query("clear_mine_count", f"WITH {PICKS} SELECT count(*) FILTER (viewer = '1') AS n_cleared FROM picks")
def clear_mine_count(spark, d):
    return P.cleared_count(X.picks(spark, d), ME)


@query("names_by_last_write", "SELECT viewer, nullif(substr(trim(name), 1, 40), '') AS name FROM (SELECT CAST(c_custkey % 7 AS VARCHAR) AS viewer, arg_max(CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END, c_custkey) AS name FROM customer GROUP BY ALL) WHERE trim(name) <> ''")
def names_by_last_write(spark, d):
    c = F.col("c_custkey")
    log = X.table(spark, d, "customer").select((c % 7).cast("string").alias("viewer"), F.when(c % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("name"), F.lit(0).alias("ts"), c.alias("seq"))
    return P.latest_names(log)


@query("browse_second_page", f"""{ALL} SELECT path, burst_rank FROM run WHERE is_representative ORDER BY score DESC, path LIMIT 50 OFFSET 50""")
def browse_second_page(spark, d):
    return B.BrowseQuery(viewer=ME, offset=50, limit=50).page(X.run(spark, d), X.picks(spark, d)).select("path", "burst_rank")


@query("picks_json_roundtrip", f"WITH {PICKS} SELECT path, viewer FROM picks")
def picks_json_roundtrip(spark, d):
    stored = FE.picks_to_json(X.picks(spark, d).withColumn("run_id", F.col("path") % 64), ["run_id"])
    return FE.picks_from_json(stored).select(F.col("path").cast("long").alias("path"), "viewer")


# --- stored features and files ----------------------------------------------------------------
def with_text(spark, d):
    text = X.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return files_of(spark, d).join(text, "path")


MEMO = f"{OLD}, now AS (SELECT f.path, f.size, f.mtime, CASE WHEN o.path IS NOT NULL THEN sha1(CAST(f.path AS VARCHAR)) ELSE sha1(coalesce(d.text, '')) END AS sha1 FROM files f JOIN documents d ON d.doc_id = f.path LEFT JOIN old o ON o.path = f.path AND o.size = f.size AND o.mtime = f.mtime)"


@query("hash_memo", f"WITH {MEMO} SELECT * FROM now")
def hash_memo(spark, d):
    return FE.memoized(with_text(spark, d), old_manifest(spark, d))


@query("hash_memo_upsert", f"WITH {MEMO} SELECT * FROM now UNION ALL SELECT path, size, mtime, sha1(CAST(path AS VARCHAR)) AS sha1 FROM old ANTI JOIN now USING (path)")
def hash_memo_upsert(spark, d):
    memo = old_manifest(spark, d).select("path", "size", "mtime", "sha1")
    return FE.upserted(memo, FE.memoized(with_text(spark, d), memo))


@query("validated_files", f"WITH {OLD} SELECT f.path, f.size, f.mtime FROM files f LEFT JOIN old o ON o.path = f.path AND o.size = f.size AND o.mtime = f.mtime WHERE (o.path IS NOT NULL OR f.size % 3 <> 0) AND f.path % 13 <> 0")
def validated_files(spark, d):
    changed_since = lambda f: f.withColumn("size", F.when(F.col("path") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return FE.validated(files_of(spark, d), old_manifest(spark, d), lambda f: f.where("size % 3 <> 0"), changed_since)


@query("feature_store", "SELECT DISTINCT sha1(coalesce(text, '')) AS sha1, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents")
def feature_store(spark, d):
    """Features computed once per content: half of the documents first, then all of them against what is stored."""
    root = X.scratch("features", spark)
    docs = X.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha1", F.sha1(F.col("text").cast("binary")))
    size = lambda todo: todo.join(docs.groupBy("sha1").agg(F.max(F.octet_length("text").cast("long")).alias("n")), "sha1")
    FE.with_features(spark, root, docs.where("doc_id % 2 = 0"), size, "size", "stub")
    return FE.with_features(spark, root, docs, size, "size", "stub").select("sha1", "n").distinct()


@query("training_labels", "WITH f AS (SELECT doc_id AS path, sha1(coalesce(text, '')) AS sha1, CASE doc_id % 4 WHEN 0 THEN 'Good' WHEN 1 THEN 'Bad' WHEN 2 THEN 'Top' ELSE 'Other' END AS folder FROM documents) SELECT sha1, min(path) AS path, CAST(max(CASE folder WHEN 'Bad' THEN 0 ELSE 1 END) AS INT) AS y, bool_or(folder = 'Top') AS must_find FROM f WHERE folder <> 'Other' GROUP BY sha1")
def training_labels(spark, d):
    k = F.col("doc_id") % 4
    files = X.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha1"), F.when(k == 0, "Good").when(k == 1, "Bad").when(k == 2, "Top").otherwise("Other").alias("folder"))
    return FE.labelled_files(files, ("Top",)).select("sha1", "path", "y", "must_find")


# --- measurements -----------------------------------------------------------------------------
@query("quality_vectors", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS face_detected, l_discount AS face_frac, round(ln(1 + greatest(l_extendedprice / 5000 - 2, 0)), 6) AS sharpness_log, CASE WHEN l_linenumber % 3 = 0 THEN 1.0::DOUBLE ELSE l_tax END AS ear, 0.0::DOUBLE AS mar, l_quantity / 100 AS exposure_clipped_frac, 0.5::DOUBLE AS face_centeredness FROM lineitem""")
def quality_vectors(spark, d):
    c = F.col
    measured = F.map_from_arrays(F.array(*[F.lit(k) for k in ("face_detected", "face_frac", "sharpness", "ear", "exposure_clipped_frac")]), F.array(F.when(c("l_linenumber") % 2 == 0, 1.0).otherwise(0.0), "l_discount", c("l_extendedprice") / 5000 - 2, "l_tax", c("l_quantity") / 100))
    q = F.map_filter(measured, lambda k, _: ~((k == "ear") & (c("l_linenumber") % 3 == 0)))
    rows = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.quality_vector(q).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", *[(F.round(F.get("v", i), 6) if n == "sharpness_log" else F.get("v", i)).alias(n) for i, n in enumerate(G.QUALITY)])


@query("face_ratios", """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 4 AS DOUBLE) AS w, l_discount * 10 AS a, l_tax * 10 AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN w = 0 THEN 0 ELSE (sqrt(1 + (a + b) * (a + b)) + (a + b)) / (2 * w) END, 6) AS ear, round(CASE WHEN w = 0 THEN 0 ELSE (a + b) / w END, 6) AS mar FROM p""")
def face_ratios(spark, d):
    c = F.col
    p = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_linenumber") % 4).cast("double").alias("w"), (c("l_discount") * 10).alias("a"), (c("l_tax") * 10).alias("b"))
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if isinstance(x, (int, float)) else x.alias("x"), F.lit(y).cast("double").alias("y") if isinstance(y, (int, float)) else y.alias("y"))
    eye = F.array(at(0, 0), at(1, c("a")), at(0, c("a")), at(c("w"), 0), at(0, -c("b")), at(0, -c("b")))
    mouth = F.array(at(0, 0), at(c("w"), 0), at(0, c("a")), at(0, -c("b")))
    return p.select("l_orderkey", "l_linenumber", F.round(G.eye_ratio(eye), 6).alias("ear"), F.round(G.mouth_ratio(mouth), 6).alias("mar"))


@query("crop_boxes", """WITH b AS (SELECT l_orderkey, l_linenumber, l_orderkey % 500 AS x, l_partkey % 300 AS y, 20 + l_suppkey % 50 AS w, 30 + l_linenumber AS h, 640 AS wide, 480 AS high FROM lineitem),
    s AS (SELECT *, greatest(w, h) * 0.775::DOUBLE AS half, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy FROM b),
    f AS (SELECT *, CAST(trunc(greatest(0, cx - half)) AS INT) AS x0, CAST(trunc(greatest(0, cy - half)) AS INT) AS y0, CAST(trunc(least(wide, cx + half)) AS INT) AS x1, CAST(trunc(least(high, cy + half)) AS INT) AS y1 FROM s)
    SELECT l_orderkey, l_linenumber, x0, y0, x1, y1, CAST(trunc(greatest(0, x0 - w * 0.5::DOUBLE)) AS INT) AS body_x0, CAST(trunc(greatest(0, y0 - h * 0.25::DOUBLE)) AS INT) AS body_y0, CAST(trunc(least(wide, x1 + w * 0.5::DOUBLE)) AS INT) AS body_x1, CAST(high AS INT) AS body_y1,
        CAST(80 AS INT) AS mid_left, CAST(0 AS INT) AS mid_top, CAST(480 AS INT) AS mid_side, round((x1 - x0) * (y1 - y0) / (wide * high)::DOUBLE, 6) AS face_frac, round(1 - sqrt(pow((cx - 320) / 320, 2) + pow((cy - 240) / 240, 2)) / sqrt(2), 6) AS centeredness FROM f""")
def crop_boxes(spark, d):
    c = F.col
    b = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_orderkey") % 500).alias("x"), (c("l_partkey") % 300).alias("y"), (c("l_suppkey") % 50 + 20).alias("w"), (c("l_linenumber") + 30).alias("h"), F.lit(640).alias("wide"), F.lit(480).alias("high"))
    size = c("wide"), c("high")
    out = b.withColumns(G.face_square(c("x"), c("y"), c("w"), c("h"), *size))
    out = out.withColumns({f"body_{k}": v for k, v in G.body_box(c("x0"), c("y0"), c("x1"), c("w"), c("h"), *size).items()}).withColumns({f"mid_{k}": v for k, v in G.center_square(*size).items()})
    out = out.withColumns({"face_frac": F.round(G.face_share(c("x0"), c("y0"), c("x1"), c("y1"), *size), 6), "centeredness": F.round(G.centeredness(c("x") + c("w") / 2, c("y") + c("h") / 2, *size), 6)})
    return out.drop("x", "y", "w", "h", "wide", "high")


# --- watched folder ---------------------------------------------------------------------------
@query("watch_states", f"""WITH {LISTINGS}, n AS (SELECT *, CASE WHEN lag(size) OVER w IS DISTINCT FROM size OR lag(mtime) OVER w IS DISTINCT FROM mtime OR lag(tick) OVER w IS DISTINCT FROM tick - 1 THEN tick END AS fresh FROM ls WINDOW w AS (PARTITION BY path ORDER BY tick)),
    s AS (SELECT *, max(fresh) OVER (PARTITION BY path ORDER BY tick) AS since FROM n)
    SELECT path, size, mtime, since, CASE WHEN tick - since < 2 THEN 'pending' WHEN path % 10 = 0 THEN 'unusable' ELSE 'known' END AS status FROM s WHERE tick = 4""")
def watch_states(spark, d):
    """Five listings, one micro-batch each, with a batch ingested as soon as a file is ready."""
    c = F.col
    docs = X.table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("tick"))
    docs = docs.where(~((c("doc_id") % 9 == 0) & (c("tick") > 3)) & (c("doc_id") % 3 <= c("tick")))
    ls = docs.select("tick", c("doc_id").alias("path"), (c("n_chars") + F.when(c("doc_id") % 4 == 0, F.least("tick", F.lit(2).cast("long"))).otherwise(0)).alias("size"), c("doc_id").alias("mtime"))
    w = W.Watcher(spark, X.scratch("watch", spark), ingest=lambda files: True, usable=lambda f: f.where("CAST(path AS LONG) % 10 <> 0"), cooldown=0.0)
    for tick in range(5):
        w.tick(ls.where(c("tick") == tick))
    return written(w.state()).select(c("path").cast("long").alias("path"), "size", "mtime", "since", "status")


# --- a run that follows its folder -------------------------------------------------------------
@query("incremental_run", f"WITH {FRAMES}, {BURSTS}, {RANKED} SELECT {', '.join(COLS)} FROM ranked")
def incremental_run(spark, d):
    """All frames in two batches, the second of which also takes back and gives again some of the first: as if derived at once."""
    root, c = X.scratch("follow", spark), F.col
    frames = written(X.frames(spark, d).select("path", "camera_id", "captured_at", "emb", "score"))
    gaps = (X.SHORT, X.LONG, X.ALIKE)
    early = frames.where(c("path") % 10 != 3).withColumn("score", F.when(c("path") % 50 == 0, c("score") + 1).otherwise(c("score")))
    I.update_run(spark, root, early, gaps=gaps)
    I.update_run(spark, root, frames.where((c("path") % 10 == 3) | (c("path") % 50 == 0)), gaps=gaps)
    return I.read_run(spark, root, frames).select(*COLS)

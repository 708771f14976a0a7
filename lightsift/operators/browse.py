"""Ranked, chronological and pick-count pages with filters, quality cut and per-burst collapsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantiles, value_ranks
from .picks import pick_flags


def thresholds(run: DataFrame) -> DataFrame:
    """(top_pct, threshold) for each whole percentage below 100 of a ranked run: published beside it, so no page computes
    it again. The two scores around each place are looked up by rank."""
    total = run.agg(F.count_if(F.col("score").isNotNull() & ~F.isnan("score")).alias("n"))  # one row; frames without a score rank last
    at = (1 - F.col("top_pct") / 100.0) * (F.col("n") - 1)
    wanted = run.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("top_pct")).crossJoin(F.broadcast(total))
    wanted = wanted.select("top_pct", (F.col("n") - F.floor(at)).alias("low"), (F.col("n") - F.ceil(at)).alias("high"), (at - F.floor(at)).alias("part"))
    scores = lambda place, name: run.select(F.col("rank").alias(place), F.col("score").alias(name))
    found = scores("high", "above").join(F.broadcast(scores("low", "below").join(F.broadcast(wanted), "low")), "high")  # 99 rows
    return found.select("top_pct", (F.col("below") + (F.col("above") - F.col("below")) * F.col("part")).alias("threshold"))


def quality_threshold(frames: DataFrame, top_pct: float, known: DataFrame | None = None) -> DataFrame:
    """One row: the score that the best top_pct percent of the whole run reach (linear interpolation); looked up where it is known."""
    if known is not None and float(top_pct).is_integer() and 1 <= top_pct < 100:
        return known.where(F.col("top_pct") == int(top_pct)).select("threshold")
    return quantiles(frames, F.col("score"), [1 - top_pct / 100.0]).select(F.col("q")[0].alias("threshold"))


def quality_cut(frames: DataFrame, top_pct: float | str | None, run: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Frames at or above the threshold of the run before any other filter; 100 or an unreadable value keeps all."""
    try:
        pct = min(100.0, max(1.0, float(top_pct)))
    except (TypeError, ValueError):
        return frames
    if pct >= 100:
        return frames
    return frames.crossJoin(F.broadcast(quality_threshold(frames if run is None else run, pct, known))).where("score >= threshold").drop("threshold")


@dataclass(frozen=True)
class BrowseQuery:
    """One page request. Filters come before the choice of a burst's frame; the quality cut looks at the whole run."""

    shot: str = ""
    subject: str = ""
    hero: bool = False
    top_pct: float | None = None
    sort: str = "rank"
    unfurl: bool = False
    owner: str = "all"
    viewer: str = ""
    offset: int = 0
    limit: int = 50

    def matching(self, frames: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Filters on columns that frames lack do nothing."""
        out = quality_cut(frames, self.top_pct, known=known)
        shots = [s for s in self.shot.split(",") if s]
        if shots and "shot_type" in frames.columns:
            out = out.where(F.col("shot_type").isin(shots))
        if self.subject and "subject_class" in frames.columns:
            out = out.where(F.col("subject_class") == self.subject)
        if self.hero and "is_hero" in frames.columns:
            out = out.where("is_hero")
        return out

    def order(self) -> list:
        best = [F.desc("score"), F.asc("path")]
        return {"rank": best, "time": [F.asc_nulls_last("captured_at"), F.asc("within_burst_rank"), F.asc("rank")], "stars": [F.desc("n_picks"), *best]}[self.sort]

    def chosen(self, frames: DataFrame, picks: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
        """One row per burst, or all frames if unfurled (then ranked over the whole run); with pick flags if picks are given."""
        shown = frames
        if self.unfurl:
            ranks = value_ranks(frames, "score", "score_rank").withColumnRenamed("score", "_score")
            placed = frames if "score_rank" in frames.columns else frames.join(ranks, F.col("score").eqNullSafe(F.col("_score"))).drop("_score")
            shown = placed.withColumn("burst_rank", F.col("score_rank"))
        out = self.matching(shown, known)
        out = out if picks is None else pick_flags(out, picks, self.viewer)
        if not self.unfurl:
            first = F.row_number().over(Window.partitionBy("burst_id").orderBy(*self.order()))
            out = out.withColumn("_first", first).where("_first = 1").drop("_first")
        return out

    def rows(self, frames: DataFrame, picks: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """All rows the pages are cut from, with pick flags."""
        if self.sort == "stars":
            return self.chosen(frames, picks, known)
        return pick_flags(self.chosen(frames, None, known), picks, self.viewer)

    def page(self, frames: DataFrame, picks: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """One page, at most 500 rows. Unless picks decide the order, they are looked up for the page's frames only."""
        at, many = max(0, int(self.offset)), min(500, max(1, int(self.limit)))
        if self.sort == "stars":
            return self.rows(frames, picks, known).orderBy(*self.order()).offset(at).limit(many)
        chosen = self.chosen(frames, None, known)
        rows = chosen.orderBy(*self.order()).offset(at).limit(many).collect()  # at most 500
        page = frames.sparkSession.createDataFrame(rows, chosen.schema)
        own = picks.where(F.col("path").isin([r["path"] for r in rows]))
        return pick_flags(page, own, self.viewer).orderBy(*self.order())

    def total(self, frames: DataFrame, known: DataFrame | None = None) -> int:
        return self.chosen(frames, None, known).count() if self.unfurl else self.matching(frames, known).select("burst_id").distinct().count()


def burst_detail(frames: DataFrame, top_pct: float, burst_ids: list[int] | None = None, sort: str = "rank", known: DataFrame | None = None) -> DataFrame:
    """Frames of bursts above the run's threshold, a burst that would be empty whole; by rank in the burst, or by time."""
    limit = quality_threshold(frames, top_pct, known)
    some = frames if burst_ids is None else frames.where(F.col("burst_id").isin(burst_ids))
    kept = some.crossJoin(F.broadcast(limit)).withColumn("_ok", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    shown = kept.select("burst_id", "_ok").groupBy("burst_id").agg(F.max("_ok").alias("_any")).where("_any")
    return kept.join(shown, "burst_id", "left").where("_ok OR _any IS NULL").select(*frames.columns).orderBy("burst_id", *detail_order(frames, sort))


def detail_order(frames: DataFrame, sort: str) -> list:
    by_rank = [F.asc("within_burst_rank")] if "within_burst_rank" in frames.columns else []
    return [*([F.asc_nulls_last("captured_at")] if sort == "time" else []), *by_rank, F.asc("path")]


def run_stats(frames: DataFrame, picks: DataFrame, query: BrowseQuery, known: DataFrame | None = None) -> DataFrame:
    """Counts of the run; frames shown: those above the cut in bursts of which any frame matches."""
    sizes = frames.groupBy("burst_id").agg(F.count(F.lit(1)).alias("n"))
    bursts = sizes.agg(F.sum("n").alias("n_frames"), F.count(F.lit(1)).alias("n_bursts"), F.count_if(F.col("n") > 1).alias("n_multi"))
    starred = picks.agg(F.count_distinct("path").alias("n_starred"))
    visible = query.matching(frames, known).select("burst_id").distinct()
    shown = quality_cut(frames, query.top_pct, known=known).join(visible, "burst_id", "left_semi").agg(F.count(F.lit(1)).alias("n_frames_shown"))
    return bursts.crossJoin(starred).crossJoin(shown)  # one row each

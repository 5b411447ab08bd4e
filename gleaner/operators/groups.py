"""Groups from similarity edges: members, winners, actions, confidence, fusion and uniqueness.

Groups and their members are two flat tables: groups (group_id, group_type,
confidence, recommended_file_id) and items (group_id, file_id, path, action,
similarity, quality, size_bytes). No group is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import clean_path
from ..storage import materialise
from .components import connected_components

KEEP, CLEANUP, REVIEW = "keep_recommended", "cleanup_candidate", "review_required"


def group_confidence(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, confidence): the least similarity of all member pairs, 0 if any pair has none; at most 1."""
    size = members.groupBy("group_id").agg(F.count("*").alias("n"))
    inside = edges.join(members.select(F.col("file_id").alias("src"), "group_id"), "src").groupBy("group_id").agg(F.count("*").alias("e"), F.min("sim").alias("low"))
    whole = F.col("e") >= F.col("n") * (F.col("n") - 1) / 2
    return size.join(inside, "group_id", "left").select("group_id", F.when(whole, F.least(F.col("low"), F.lit(1.0))).otherwise(0.0).alias("confidence"))


def choose_actions(items: DataFrame, delta: float = config.REVIEW_DELTA) -> DataFrame:
    """items (group_id, file_id, quality) with recommended_file_id and action.

    The best quality wins, the smaller id on ties. Where the two best are within
    delta all members need review; a negative delta never asks for it.
    """
    order = F.struct(F.col("quality"), (-F.col("file_id")).alias("t"))
    top = items.groupBy("group_id").agg(F.max_by("file_id", order).alias("recommended_file_id"), F.max("quality").alias("q1"), F.count("*").alias("n"))
    second = items.join(top.select("group_id", "recommended_file_id"), "group_id").where("file_id <> recommended_file_id").groupBy("group_id").agg(F.max("quality").alias("q2"))
    facts = top.join(second, "group_id", "left").withColumn("review", (F.col("n") > 1) & F.lit(delta >= 0) & (F.col("q1") - F.col("q2") <= delta)).select("group_id", "recommended_file_id", "review")
    return items.join(facts, "group_id").withColumn("action", F.when(F.col("review"), REVIEW).when(F.col("file_id") == F.col("recommended_file_id"), KEEP).otherwise(CLEANUP)).drop("review")


def similarity_to_winner(items: DataFrame, edges: DataFrame) -> DataFrame:
    """items (file_id, recommended_file_id) with similarity: 1 for the winner, -1 where no edge leads to it."""
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "sim")
    keyed = items.withColumn("a", F.least("file_id", "recommended_file_id")).withColumn("b", F.greatest("file_id", "recommended_file_id"))
    return keyed.join(known, ["a", "b"], "left").withColumn("similarity", F.when(F.col("file_id") == F.col("recommended_file_id"), 1.0).otherwise(F.coalesce("sim", F.lit(config.NO_DIRECT)))).drop("a", "b", "sim")


def groups_from_edges(edges: DataFrame, files: DataFrame, group_type: str, delta: float = config.REVIEW_DELTA) -> tuple[DataFrame, DataFrame]:
    """(groups, items) of the components of edges (src, dst, sim), over files (file_id, path, size_bytes, quality)."""
    members = connected_components(edges).select(F.col("id").alias("file_id"), F.col("component").alias("group_id")).join(files.select("file_id", "path", "size_bytes", "quality"), "file_id")
    items = similarity_to_winner(choose_actions(members, delta), edges)
    groups = items.groupBy("group_id").agg(F.first("recommended_file_id").alias("recommended_file_id")).join(group_confidence(members, edges), "group_id").withColumn("group_type", F.lit(group_type))
    return groups, items.drop("recommended_file_id")


def text_groups(facts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, items): the largest file wins, the smaller id on ties, and all others need review."""
    members = connected_components(edges).select(F.col("id").alias("file_id"), F.col("component").alias("group_id")).join(facts.select("file_id", "path", "size_bytes"), "file_id")
    top = members.groupBy("group_id").agg(F.max_by("file_id", F.struct("size_bytes", (-F.col("file_id")).alias("t"))).alias("recommended_file_id"))
    items = similarity_to_winner(members.join(top, "group_id"), edges).withColumn("action", F.when(F.col("file_id") == F.col("recommended_file_id"), KEEP).otherwise(REVIEW))
    groups = top.join(group_confidence(members, edges), "group_id").withColumn("group_type", F.lit("similar_text"))
    return groups, items.drop("recommended_file_id")


def fuse_exact(groups: DataFrame, items: DataFrame, exact: DataFrame, exact_items: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold exact groups into the similarity group that their representative is in.

    exact: (group_id, recommended_file_id); exact_items: (group_id, file_id, path,
    quality, size_bytes); reps: (group_id, rep_id). Result: groups, items, and the
    ids of absorbed exact groups. A copy takes the verdict of its representative, a
    second keep becomes cleanup, and confidences stay.
    """
    rep = reps.select(F.col("group_id").alias("exact_id"), "rep_id").join(exact.select(F.col("group_id").alias("exact_id"), F.col("recommended_file_id").alias("original")), "exact_id")
    met = items.select("group_id", F.col("file_id").alias("rep_id"), F.col("action").alias("rep_action"), F.col("similarity").alias("rep_similarity")).join(rep, "rep_id")
    winner = groups.join(met.select("group_id", F.col("rep_id").alias("recommended_file_id"), "original"), ["group_id", "recommended_file_id"], "left")
    fused = winner.withColumn("winner_rep", F.when(F.col("original").isNotNull(), F.col("recommended_file_id"))).withColumn("recommended_file_id", F.coalesce("original", "recommended_file_id")).drop("original")
    copies = exact_items.select(F.col("group_id").alias("exact_id"), "file_id", "path", "quality", "size_bytes").join(met, "exact_id")
    copies = copies.join(items.select("group_id", "file_id"), ["group_id", "file_id"], "left_anti").join(fused.select("group_id", "winner_rep"), "group_id")
    copies = copies.select("group_id", "file_id", "path", F.col("rep_action").alias("action"), F.when(F.col("rep_id") == F.col("winner_rep"), 1.0).otherwise(F.col("rep_similarity")).alias("similarity"), "quality", "size_bytes")
    whole = items.select(copies.columns).unionByName(copies).join(fused.select("group_id", F.col("recommended_file_id").alias("w")), "group_id")
    whole = whole.withColumn("action", F.when((F.col("action") == KEEP) & (F.col("file_id") != F.col("w")), CLEANUP).otherwise(F.col("action")))
    inherit = met.where("rep_action = 'keep_recommended'").select("group_id", F.lit(True).alias("kept")).distinct()
    whole = whole.join(inherit, "group_id", "left").withColumn("action", F.when((F.col("file_id") == F.col("w")) & F.col("kept"), KEEP).otherwise(F.col("action"))).drop("w", "kept")
    return fused.drop("winner_rep"), whole, met.select(F.col("exact_id").alias("group_id")).distinct()


def _first_claims(rows: DataFrame, place: list[str], within: list[str]) -> DataFrame:
    """rows with `ahead`: whether another `place` comes first at the row's path or file id, within the same `within`."""
    at = F.struct(*place)
    for key in ("clean", "file_id"):
        first = rows.groupBy(*within, key).agg(F.min(at).alias(f"first {key}"))
        rows = rows.join(first, [*within, key])
    return rows.withColumn("ahead", (F.col("first clean") < at) | (F.col("first file_id") < at)).drop("first clean", "first file_id")


def _greedy(rows: DataFrame, place: list[str], within: list[str], least: int) -> DataFrame:
    """What stays of rows (clean, file_id, *place) if each `place` in turn keeps what no earlier one has claimed.

    A place with fewer than `least` rows left claims nothing. In a round, all
    places decide that are first at each of their keys; the rest wait, without the
    rows that were claimed. The rounds end when none waits, and there are as many
    as the longest chain of places of which each waits for the one before.
    """
    kept, waiting = None, rows
    while True:
        seen = materialise(_first_claims(waiting, place, within), "claims")
        places = [*within, *(c for c in place if c not in within)]
        sizes = seen.groupBy(*places).agg(F.count("*").alias("rows"), F.bool_or("ahead").alias("waits"))
        ready = materialise(seen.join(sizes, places), "claims")
        stands = ready.where((F.col("rows") >= least) & ~F.col("waits")).select(*rows.columns)
        kept = stands if kept is None else kept.unionByName(stands)
        left = ready.where((F.col("rows") >= least) & F.col("waits")).select(*rows.columns)
        if left.isEmpty():
            return kept
        for key in ("clean", "file_id"):
            left = left.join(stands.select(*within, key).distinct(), [*within, key], "left_anti")
        waiting = left.select(*rows.columns)


def path_unique(groups: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each path and file in one group at most, that of the first group in (type, group_id) order which stands.

    A group keeps the members that no group before it holds; with fewer than two
    left it is dissolved and claims nothing. Paths are compared by clean_path().
    Inside a group the first of equal members, by file_id and path, stays. Where
    groups have a recommended_file_id that went, another is chosen (rescore).
    """
    rank = F.array_position(F.array(*(F.lit(t) for t in config.TYPE_ORDER)), F.col("group_type"))
    rows = items.join(groups.select("group_id", rank.alias("rank")), "group_id").select("group_id", "rank", "file_id", "path", clean_path("path").alias("clean")).distinct()
    twice = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("clean").alias("paths"), F.countDistinct("file_id").alias("files")).where("n > paths OR n > files").select("group_id")
    repeated = materialise(rows.join(twice, "group_id", "left_semi"), "repeated")
    inside = materialise(rows.join(twice, "group_id", "left_anti"), "inside")
    if not repeated.isEmpty():
        inside = inside.unionByName(_greedy(repeated, ["file_id", "path"], ["group_id"], 1))
    kept = materialise(_greedy(inside, ["rank", "group_id"], [], 2).select("group_id", "file_id", "path"), "kept")
    left = items.join(kept, ["group_id", "file_id", "path"], "left_semi").select(items.columns).dropDuplicates(["group_id", "file_id", "path"])
    alive = groups.join(kept.select("group_id").distinct(), "group_id", "left_semi").select(groups.columns)
    return rescore(alive, left) if {"recommended_file_id"} <= set(groups.columns) else (alive, left)


def rescore(groups: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the winner is gone, the best quality wins: similarity 1 for it and -1 for others, but exact groups keep theirs."""
    there = groups.join(items.select("group_id", F.col("file_id").alias("recommended_file_id")), ["group_id", "recommended_file_id"], "left_semi").select("group_id")
    lost = groups.join(there, "group_id", "left_anti")
    fresh = choose_actions(items.join(lost.select("group_id", "group_type"), "group_id"), config.REVIEW_DELTA)
    exact = F.col("group_type") == "exact"
    won = F.col("file_id") == F.col("recommended_file_id")
    fresh = fresh.withColumn("action", F.when(exact, F.when(won, KEEP).otherwise(CLEANUP)).otherwise(F.col("action"))).withColumn("similarity", F.when(exact, F.col("similarity")).when(won, 1.0).otherwise(config.NO_DIRECT))
    picks = fresh.groupBy("group_id").agg(F.first("recommended_file_id").alias("pick"))
    out = groups.join(picks, "group_id", "left").withColumn("recommended_file_id", F.coalesce("pick", "recommended_file_id")).drop("pick")
    return out, items.join(lost, "group_id", "left_anti").unionByName(fresh.select(items.columns))


def drop_failed(groups: DataFrame, items: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (file_id) that failed go; groups of one go; winners that went are replaced."""
    left = items.join(failed.select("file_id"), "file_id", "left_anti")
    alive = left.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return rescore(groups.join(alive, "group_id", "left_semi"), left.join(alive, "group_id", "left_semi").select(items.columns))

"""Centres, medoids and representative sequences from a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .discrepancy import overall_discrepancy
from .distances import both_ways
from .mismatches import Mismatches
from .tables import reads_pairs_often, running, stored


def weighted_distance_sums(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, group, weight, total): the weighted sum of distances to the rows of one's own group; ``rows``: (id, weight, group)."""
    if isinstance(pairs, Mismatches):
        return pairs.totals(rows)
    a, b = rows.select(F.col("id").alias("i"), F.col("group").alias("gi")), rows.select(F.col("id").alias("j"), F.col("group").alias("gj"), F.col("weight").alias("wj"))
    sums = both_ways(pairs).join(a, "i").join(b, "j").where("gi = gj").groupBy("i").agg(F.sum(F.col("wj") * F.col("d")).alias("total"))
    return rows.join(sums.withColumnRenamed("i", "id"), "id", "left").select("id", "group", "weight", F.coalesce("total", F.lit(0.0)).alias("total"))


def medoids(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(group, medoid, total): the row with the least weighted sum of distances; the least id of equal ones."""
    sums = weighted_distance_sums(pairs, rows).withColumn("total", F.round("total", 9))
    return sums.groupBy("group").agg(F.min(F.struct("total", "id")).alias("x")).select("group", F.col("x.id").alias("medoid"), F.col("x.total").alias("total"))


def neighbourhood_density(pairs: DataFrame, rows: DataFrame, share: float = 0.1) -> DataFrame:
    """(id, density): weight within ``share`` of the largest distance, one's own included."""
    if isinstance(pairs, Mismatches):
        near = pairs.near(rows, (pairs.largest() or 0.0) * share)
        return rows.join(near, "id", "left").select("id", (F.col("weight") + F.coalesce("s", F.lit(0.0))).alias("density"))
    radius = pairs.agg((F.max("d") * share).alias("r"))
    near = both_ways(pairs).join(F.broadcast(radius), how="cross").where("d < r").join(rows.select(F.col("id").alias("j"), F.col("weight").alias("wj")), "j").groupBy("i").agg(F.sum("wj").alias("s"))
    return rows.join(near.withColumnRenamed("i", "id"), "id", "left").select("id", (F.col("weight") + F.coalesce("s", F.lit(0.0))).alias("density"))


@reads_pairs_often
def representatives(pairs: DataFrame, rows: DataFrame, coverage: float = 0.25, share: float = 0.1, most: int = 20, criterion: str = "density", seed: int = 1) -> DataFrame:
    """(rank, id, covered, share): greedy picks by density, weight (``freq``), nearness to all (``dist``) or chance (``random``), none within the radius of another, until ``coverage`` of the weight.

    The loop runs over picks, of which there are ``most`` at most; each is a scan of the table, or of the sequences alone
    where ``pairs`` are mismatches.
    """
    spark = rows.sparkSession
    rows = stored(rows)
    summed = isinstance(pairs, Mismatches)
    radius = (pairs.largest() if summed else pairs.agg(F.max("d")).first()[0]) or 0.0
    limit = radius * share
    if criterion == "density" and summed:
        score = rows.join(pairs.near(rows, limit), "id", "left").select("id", (F.col("weight") + F.coalesce("s", F.lit(0.0))).alias("density"))
    elif criterion == "density":
        score = neighbourhood_density(pairs, rows, share)
    elif criterion == "freq":
        score = rows.select("id", F.col("weight").alias("density"))
    elif criterion == "dist":
        score = weighted_distance_sums(pairs, rows.select("id", "weight", F.lit(1).alias("group"))).select("id", (-F.col("total")).alias("density"))
    elif criterion == "random":
        score = rows.select("id", F.xxhash64(F.lit(seed), "id").cast("double").alias("density"))
    else:
        raise ValueError("criterion is density, freq, dist or random")
    score = stored(score)
    total = rows.agg(F.sum("weight")).first()[0] or 0.0
    sides = None if summed else both_ways(pairs).where(F.col("d") < limit)
    picked: list[int] = []
    out = []
    covered = 0.0
    left = score
    while len(picked) < most and covered < coverage * total:
        top = left.orderBy(F.desc("density"), "id").first()
        if top is None:
            break
        picked.append(top.id)
        beside = pairs.beside(picked, limit) if summed else sides.where(F.col("i").isin(picked)).select(F.col("j").alias("id")).distinct()
        near = beside.unionByName(rows.where(F.col("id").isin(picked)).select("id")).distinct()
        covered = rows.join(near, "id", "left_semi").agg(F.sum("weight")).first()[0]
        out.append((len(picked), int(top.id), float(covered), float(covered / total)))
        left = score.join(near, "id", "left_anti")
    return spark.createDataFrame(out, "rank int, id long, covered double, share double")


@reads_pairs_often
def frequency_groups(pairs: DataFrame, rows: DataFrame, groups: int, order: DataFrame) -> DataFrame:
    """(group, medoid, n, total, r2): rows cut into equal weights along ``order`` (id, key), with each part's medoid.

    total is the group's summed distance to its medoid; r2 the share of the overall sum of squares that the medoids explain.
    """
    placed = stored(rows.join(order, "id"))
    total = placed.agg(F.sum("weight")).first()[0] or 0.0
    grouped = running(placed, ["key", "id"], {"upto": "weight"}).withColumn("group", F.least(F.floor((F.col("upto") - F.col("weight")) / (total / groups)) + 1, F.lit(groups))).select("id", "weight", "group")
    grouped = stored(grouped)
    found = medoids(pairs, grouped)
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n"))
    whole = overall_discrepancy(pairs, rows.select("id", "weight")).select(F.col("ss").alias("whole"))
    left = found.agg(F.sum("total").alias("left_out"))
    share = F.greatest(F.lit(0.0), 1 - F.col("left_out") / F.nullif("whole", F.lit(0.0)))
    return found.join(sizes, "group").join(F.broadcast(whole), how="cross").join(F.broadcast(left), how="cross").select("group", "medoid", "n", "total", share.alias("r2"))


def distance_to_most_frequent(frame) -> list[int]:
    """The most frequent sequence; the first in order of states of equal ones."""
    row = frame.unique.orderBy(F.desc("weight"), "seq").first()
    return list(row.seq) if row else []


def classical_scaling(pairs: DataFrame, rows: DataFrame, most: int = 3_000) -> DataFrame:
    """(id, key): the first axis of classical scaling of at most ``most`` rows, in one task."""
    import numpy as np

    from .clustering import in_one_group

    def scale(ids: np.ndarray, weights: np.ndarray, d: np.ndarray) -> dict:
        q = d**2
        m = q.mean(axis=1)
        values, vectors = np.linalg.eigh(-0.5 * (q - m[:, None] - m[None] + m.mean()))
        axis = vectors[:, -1] * np.sqrt(max(0.0, float(values[-1])))
        return {"id": ids, "key": axis * (1 if axis[np.abs(axis).argmax()] >= 0 else -1)}

    return in_one_group(pairs, rows, scale, "id long, key double", most)


@reads_pairs_often
def trimmed_center(pairs: DataFrame, rows: DataFrame, trim: float = 0.2) -> DataFrame:
    """(id, group, weight, dc, kept): distances to a group's centre that leaves out the share ``trim`` of rows that lie farthest.

    A first pass gives distances to the whole centre; rows beyond their (1 - trim) quantile are left out of the second.
    """
    from .discrepancy import distances_to_center, group_discrepancy

    first = stored(distances_to_center(pairs, rows))
    cut = first.groupBy("group").agg(F.percentile("dc", F.lit(1 - trim)).alias("cut"))
    kept = stored(first.join(cut, "group").where(F.col("dc") <= F.col("cut") + 1e-12).select("id", "group", "weight"))
    a, b = rows.select(F.col("id").alias("i"), F.col("group").alias("gi")), kept.select(F.col("id").alias("j"), F.col("group").alias("gj"), F.col("weight").alias("wj"))
    sums = both_ways(pairs).join(a, "i").join(b, "j").where("gi = gj").groupBy("i").agg(F.sum(F.col("wj") * F.col("d")).alias("s"))
    groups = group_discrepancy(pairs, kept).select("group", F.col("weight").alias("W"), "discrepancy")
    joined = rows.join(sums.withColumnRenamed("i", "id"), "id", "left").join(groups, "group").join(kept.select("id", F.lit(True).alias("k")), "id", "left")
    return joined.select("id", "group", "weight", (F.coalesce("s", F.lit(0.0)) / F.col("W") - F.col("discrepancy")).alias("dc"), F.coalesce("k", F.lit(False)).alias("kept"))

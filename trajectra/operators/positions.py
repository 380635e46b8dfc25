"""Groups of sequences compared position by position, by the Hamming distances in a window around each.

No pairs are made. Windows of a position are gathered by group and content; the mismatches of all
pairs follow from the weights by state at each of its places, and so do the distances of a content
to its group's centre. So after the first shuffle there is a row per position, group and content of
a window, however many sequences there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import SequenceFrame


def windows(frame: SequenceFrame, labels: DataFrame, before: int = 0, after: int = 1) -> DataFrame:
    """(pos, group, codes, weight): the contents of the windows from ``before`` places before a position to ``after`` after it, and the weight that has them.

    ``labels``: (id, group). A sequence counts at the positions whose whole window it has; ids without a group, or a null one, don't.
    """
    rows = frame.long.join(labels.where("group IS NOT NULL"), "id").select("id", "pos", "code", "group", "weight")
    shifted = rows.select("id", "code", "group", "weight", F.col("pos").alias("at"), F.explode(F.transform(F.sequence(F.lit(-after), F.lit(before)), lambda o: F.col("pos") + o)).alias("pos"))
    whole = shifted.groupBy("id", "pos").agg(F.first("group").alias("group"), F.first("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("x"))
    whole = whole.where(F.size("x") == before + after + 1)
    return whole.groupBy("pos", "group", F.col("x.code").alias("codes")).agg(F.sum("weight").alias("weight"))


def _by_group(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pos, group, w, s) with the weighted sum of all pairs' distances, and (pos, group, weight, far) with each content's mean distance to its group."""
    states = held.select("pos", "group", "weight", F.posexplode("codes").alias("place", "code"))
    counts = states.groupBy("pos", "group", "place", "code").agg(F.sum("weight").alias("n"))
    sums = counts.groupBy("pos", "group", "place").agg(F.sum("n").alias("w"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("s"))
    groups = sums.groupBy("pos", "group").agg(F.max("w").alias("w"), F.sum("s").alias("s"))
    spread = held.select("pos", "group", "weight", "codes", F.posexplode("codes").alias("place", "code")).join(counts, ["pos", "group", "place", "code"])
    far = spread.groupBy("pos", "group", "codes").agg(F.first("weight").alias("weight"), F.count("*").alias("places"), F.sum("n").alias("same"))
    far = far.join(groups, ["pos", "group"]).select("pos", "group", "weight", (F.col("places") - F.col("same") / F.col("w")).alias("far"))
    return groups, far


def discrepancy_by_position(frame: SequenceFrame, labels: DataFrame, before: int = 0, after: int = 1) -> DataFrame:
    """(pos, group, weight, discrepancy) of each group at each position; a null group is all of them together."""
    held = windows(frame, labels, before, after)
    every = held.groupBy("pos", "codes").agg(F.sum("weight").alias("weight")).withColumn("group", F.lit(0))
    value = [F.col("w").alias("weight"), (F.col("s") / (F.col("w") * F.col("w"))).alias("discrepancy")]
    together = _by_group(every)[0].select("pos", F.lit(None).cast(held.schema["group"].dataType).alias("group"), *value)
    return _by_group(held)[0].select("pos", "group", *value).unionByName(together)


def association_by_position(frame: SequenceFrame, labels: DataFrame, before: int = 0, after: int = 1) -> DataFrame:
    """(pos, weight, groups, pseudo_f, pseudo_fbf, pseudo_r2, bartlett, levene) of the groups at each position; null where it isn't defined."""
    held = windows(frame, labels, before, after)
    groups, far = _by_group(held)
    total = _by_group(held.groupBy("pos", "codes").agg(F.sum("weight").alias("weight")).withColumn("group", F.lit(0)))[0].select("pos", F.col("w").alias("total"), (F.col("s") / F.col("w")).alias("ss"))
    # A content's distance to its group's centre is its mean distance to the group less half the group's own mean.
    centred = far.join(groups.select("pos", "group", (F.col("s") / (F.col("w") * F.col("w"))).alias("v")), ["pos", "group"]).withColumn("dc", F.col("far") - F.col("v"))
    spread = centred.groupBy("pos", "group").agg(F.sum(F.col("weight") * F.col("dc")).alias("z1"), F.sum(F.col("weight") * F.col("dc") * F.col("dc")).alias("z2"))
    each = groups.join(spread, ["pos", "group"]).join(total, "pos").withColumn("v", F.col("s") / (F.col("w") * F.col("w")))
    w, v, big = F.col("w"), F.col("v"), F.col("w") > 1
    sums = each.groupBy("pos", "total", "ss").agg(
        F.count("*").alias("k"),
        F.sum(v * w).alias("within"),
        F.sum((1 - w / F.col("total")) * v).alias("unequal"),
        F.sum(F.when(big, (w - 1) * v).otherwise(0.0)).alias("pooled"),
        F.sum(F.when(big & (v > 0), (w - 1) * F.log(v)).otherwise(0.0)).alias("logs"),
        F.sum(F.when(big, 1 / (w - 1)).otherwise(0.0)).alias("inverse"),
        F.count_if(big & (v <= 0)).alias("same"),
        F.sum("z1").alias("z1"),
        F.sum("z2").alias("z2"),
        F.sum(F.col("z1") * F.col("z1") / w).alias("zg"),
    )
    k, n, within = F.col("k"), F.col("total"), F.col("within")
    explained, many = F.col("ss") - within, (F.col("k") > 1) & (F.col("total") > F.col("k"))
    left = F.col("z2") - F.col("zg")
    bartlett = ((n - k) * F.log(F.col("pooled") / (n - k)) - F.col("logs")) / (1 + (F.col("inverse") - 1 / (n - k)) / (3 * (k - 1)))
    return sums.select(
        "pos",
        n.alias("weight"),
        k.alias("groups"),
        F.when(many & (within > 1e-12), explained / (k - 1) / (within / (n - k))).alias("pseudo_f"),
        F.when(many & (F.col("unequal") > 1e-12), explained / F.col("unequal")).alias("pseudo_fbf"),
        (explained / F.nullif(F.col("ss"), F.lit(0.0))).alias("pseudo_r2"),
        F.when(many & (F.col("same") == 0) & (F.col("pooled") > 0), bartlett).alias("bartlett"),
        F.when(many & (left > 1e-12), (F.col("zg") - F.col("z1") * F.col("z1") / n) / (k - 1) / (left / (n - k))).alias("levene"),
    )

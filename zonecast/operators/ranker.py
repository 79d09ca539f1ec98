"""A linear ranker learnt from pairs inside query groups, and the measure it works towards.

A group is one target time. Pairs take each positive and the hardest negatives of its group and weigh what swapping
the two would change in the group's NDCG, so that mistakes near the top count most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.operators.splits import HARDNESS, active_windows
from zonecast.scale import ordered_rank
from zonecast.session import materialize


#: Greatest score, in log-odds, that a training row keeps.
MARGIN = 8.0


def _margin() -> Column:
    return F.get(vector_to_array("rawPrediction"), F.lit(1))


def _gain(rank: Column) -> Column:
    """What a positive at this rank adds to a group's DCG."""
    return F.lit(1.0) / F.log2(F.lit(1.0) + rank)


def _ideal(positives: Column) -> Column:
    """DCG of a group whose positives all stand first."""
    ranks = F.sequence(F.lit(1), F.greatest(positives, F.lit(1)).cast("int"))
    return F.when(positives > 0, F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + _gain(r))).otherwise(F.lit(0.0))


def ndcg(
    df: DataFrame, k: int | None = None, group: str = "target_time", by: Sequence[str] = ()
) -> DataFrame:
    """Mean NDCG over the groups that have a positive, of the k best rows or of all; ties are broken by zone.

    Without such a group there is no row (with ``by``) or 0 (without).
    """
    by = list(by)
    keys = [*by, group]
    order = [F.col("score").desc(), F.col("zone_id")]
    positives = df.groupBy(*keys).agg(F.sum("actual").alias("_p")).filter("_p > 0")
    if k is None:
        ranked = ordered_rank(df.select(*keys, "zone_id", "score", "actual"), order, keys, "_r")
    else:
        w = W.partitionBy(*keys).orderBy(*order)
        ranked = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    found = ranked.filter("actual = 1").groupBy(*keys).agg(F.sum(_gain(F.col("_r"))).alias("_d"))
    ideal = _ideal(F.least(F.col("_p"), F.lit(k)) if k else F.col("_p"))
    each = positives.join(found, keys, "left").select(*by, (F.coalesce("_d", F.lit(0.0)) / ideal).alias("_n"))
    return each.groupBy(*by).agg(F.coalesce(F.avg("_n"), F.lit(0.0)).alias("ndcg"), F.count(F.lit(1)).alias("groups"))


def ranked_pairs(
    df: DataFrame,
    target: str,
    order: Sequence[Column],
    hardest: int = 20,
    carry: Sequence[str] = (),
    time: str = "target_time",
    key: str = "zone_id",
) -> DataFrame:
    """(time, positive, negative, weight): each positive with the ``hardest`` first-ranked negatives of its time.

    ``order`` ranks the rows of a time, ``key`` breaks ties; times without a positive have no pair. The weight is the change
    in NDCG if the two swapped their ranks. ``carry`` columns come along from both sides, as ``<name>_positive`` and
    ``<name>_negative``. Ranks come from range partitions, so that a time may hold any number of rows; a
    positive gives ``hardest`` pairs at most, so pairs grow with the rows.
    """
    y = F.col(target).cast("int")
    rows = active_windows(df.filter(y.isNotNull()), target, time).select(time, key, y.alias("_y"), *carry, *_plain(order))
    ranked = materialize(ordered_rank(rows, [*_renamed(order), F.col(key)], [time], "_r").select(time, key, "_y", *carry, "_r"))
    positives = ranked.filter("_y = 1")
    first = W.partitionBy(time).orderBy("_r")
    negatives = (
        ranked.filter("_y = 0")
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= hardest)
        .groupBy(time)
        .agg(F.collect_list(F.struct("_r", key, *carry)).alias("_hard"))
    )
    sizes = positives.groupBy(time).agg(_ideal(F.count(F.lit(1))).alias("_ideal"))
    pairs = positives.join(negatives.join(sizes, time), time).select("*", F.explode("_hard").alias("_h"))
    swap = F.abs(_gain(F.col("_r")) - _gain(F.col("_h._r"))) / F.col("_ideal")
    sides = [c for name in carry for c in (F.col(name).alias(f"{name}_positive"), F.col(f"_h.{name}").alias(f"{name}_negative"))]
    return pairs.select(time, F.col(key).alias("positive"), F.col(f"_h.{key}").alias("negative"), swap.alias("weight"), *sides)


def _plain(order: Sequence[Column]) -> list[Column]:
    return [c.alias(f"_o{i}") for i, c in enumerate(order)]


def _renamed(order: Sequence[Column]) -> list[Column]:
    return [F.col(f"_o{i}") for i in range(len(order))]


def fit_ranker(
    df: DataFrame,
    target: str,
    features: str = "features",
    rounds: int = 3,
    hardest: int = 20,
    reg: float = 0.001,
    time: str = "target_time",
    key: str = "zone_id",
) -> PipelineModel | None:
    """Weights that put positives before negatives of their time; None where no time has both.

    Each round ranks the rows by the weights so far (first by the counts that make negatives hard), lists the pairs
    and fits a logistic regression without intercept to their weighted differences. The model's probability grows with the
    score, so it serves wherever a classifier does; scores are scaled down before, so that it does not saturate.
    """
    first = [-F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in HARDNESS if c in df.columns]
    rows = materialize(active_windows(df, target, time).select(time, key, target, features, *[c for c in HARDNESS if c in df.columns]))
    model = None
    for _ in range(rounds):
        scored = model.transform(rows) if model else rows
        order = [-_margin()] if model else first
        pairs = ranked_pairs(scored, target, order, hardest, [features], time, key)
        # Half of the pairs the other way round: both classes are there, which the solver asks for.
        turned = F.pmod(F.xxhash64(time, "positive", "negative"), F.lit(2)) == 1
        better, worse = vector_to_array(f"{features}_positive"), vector_to_array(f"{features}_negative")
        gap = F.zip_with(better, worse, lambda a, b: F.when(turned, b - a).otherwise(a - b))
        ready = materialize(pairs.select(array_to_vector(gap).alias(features), F.when(turned, 0.0).otherwise(1.0).alias("label"), "weight"))
        if ready.agg(F.countDistinct("label")).first()[0] < 2:
            break
        model = LogisticRegression(featuresCol=features, labelCol="label", weightCol="weight", fitIntercept=False, maxIter=50, regParam=reg).fit(ready)
    if model is None:
        return None
    most = model.transform(rows).agg(F.max(F.abs(_margin()))).first()[0]
    scale = ElementwiseProduct(scalingVec=Vectors.dense([MARGIN / max(most, MARGIN)] * model.numFeatures), inputCol=features, outputCol="scaled_down")
    return PipelineModel(stages=[scale, model.setFeaturesCol("scaled_down")])

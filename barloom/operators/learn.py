"""Learning on labelled events: forests, calibration, importances, feature clusters.

Models are MLlib estimators, fitted per fold on distributed rows. A forest here weighs
the impurity by the sample weight; a forest that draws rows by weight gives close, not
equal, trees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import frames as fr
from barloom.operators.ordered import positions
from barloom.session import checkpoint_dir


def training_rows(labels: DataFrame, feats: DataFrame, names) -> DataFrame:
    """(symbol, t0, t1, label, weight, features.., x): features of the entry bar."""
    j = labels.join(feats.select("symbol", F.col("bar_idx").alias("t0"), *names), ["symbol", "t0"])
    j = j.fillna(0.0, list(names)).withColumn("label", F.col("label").cast("double"))
    return VectorAssembler(inputCols=list(names), outputCol="x").transform(j)


def forest(train: DataFrame, trees: int = 50, depth: int = 5, leaf: int = 2, seed: int = 42, features: str = "x"):
    rf = RandomForestClassifier(
        featuresCol=features, labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed,
    )
    return rf.fit(train)


def predict(model, rows: DataFrame, out: str = "p") -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def settle(*frames: DataFrame) -> list[DataFrame]:
    """Write inputs that many fits read, so no fit derives them again."""
    checkpoint_dir(frames[0].sparkSession)
    return [f.checkpoint() for f in frames]


def of_role(rows: DataFrame, splits: DataFrame, fold: int, role: str) -> DataFrame:
    s = splits.filter((F.col("fold") == fold) & (F.col("role") == role)).select("symbol", "t0")
    return rows.join(s, ["symbol", "t0"], "left_semi")


def out_of_fold(rows: DataFrame, splits: DataFrame, folds: int, **kw) -> DataFrame:
    """Out-of-sample probability of every test event, per fold.

    The driver loops over the folds only; each fit and scoring is a Spark job.
    """
    rows, splits = settle(rows, splits)
    parts = []
    for f in range(folds):
        m = forest(of_role(rows, splits, f, "train"), **kw)
        parts.append(predict(m, of_role(rows, splits, f, "test")).withColumn("fold", F.lit(f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calibrated(rows: DataFrame, splits: DataFrame, folds: int, **kw) -> DataFrame:
    """Rows with ``p`` and ``calibrated``: means over the folds' pairs of model and isotonic map.

    Each fold's map is fitted on that fold's own model's scores of its test events and follows
    the same model on every row.
    """
    rows, splits = settle(rows, splits)
    out = rows
    for f in range(folds):
        m = forest(of_role(rows, splits, f, "train"), **kw)
        test = predict(m, of_role(rows, splits, f, "test"), f"_p{f}").select(f"_p{f}", "label")
        iso = IsotonicRegression(featuresCol=f"_p{f}", labelCol="label", predictionCol=f"_c{f}").fit(test)
        out = iso.transform(predict(m, out, f"_p{f}"))
    mean = lambda c: sum(F.col(f"{c}{f}") for f in range(folds)) / folds
    return out.withColumns({"p": mean("_p"), "calibrated": mean("_c")}).drop(*[f"{c}{f}" for c in ("_p", "_c") for f in range(folds)])


def mdi(model, names, spark) -> DataFrame:
    """Mean and standard error of the impurity importances over the trees."""
    imp = np.array([t.featureImportances.toArray() for t in model.trees])
    n = len(imp)
    rows = [(f, float(imp[:, i].mean()), float(imp[:, i].std(ddof=1) / np.sqrt(n))) for i, f in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, mdi_mean double, mdi_std double")


def permuted(rows: DataFrame, names, seed: int, keys=("fold",)) -> DataFrame:
    """Adds ``_v_<name>``: the columns permuted within each key.

    The values in one hash order meet the rows in another; positions come from bucket
    counts, not from one sort per key.
    """
    keys = list(keys)
    h = lambda s: F.xxhash64("symbol", "t0", F.lit(s))
    place = lambda d: positions(d, keys, ["_h"], "_i").drop("_h")
    a = place(rows.withColumn("_h", h(seed)))
    b = place(rows.select(*keys, *[F.col(n).alias(f"_v_{n}") for n in names], h(seed + 1).alias("_h")))
    return a.join(b, keys + ["_i"]).drop("_i")


def accuracy(scored: DataFrame, keys=("fold",)) -> DataFrame:
    hit = (F.col("p") >= 0.5).cast("double") == F.col("label")
    return scored.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("score"))


def mda(rows: DataFrame, splits: DataFrame, folds: int, names, seed: int = 42, **kw) -> DataFrame:
    """Score lost when one column is permuted out of fold.

    A fold's test rows are copied once per column with that column replaced, so one
    scoring per fold covers every column.
    """
    rows, splits = settle(rows, splits)
    names = list(names)
    parts = []
    for f in range(folds):
        m = forest(of_role(rows, splits, f, "train"), **kw)
        test = permuted(of_role(rows, splits, f, "test").drop("x").withColumn("fold", F.lit(f)), names, seed)
        copies = [
            F.struct(F.lit(n or "").alias("feature"), *[F.col(f"_v_{c}" if c == n else c).alias(c) for c in names])
            for n in [None, *names]
        ]
        t = test.select("fold", "label", F.explode(F.array(*copies)).alias("c")).select("fold", "label", "c.*")
        parts.append(predict(m, VectorAssembler(inputCols=names, outputCol="x").transform(t)))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    a = accuracy(scored, ("fold", "feature"))
    base = F.max(F.when(F.col("feature") == "", F.col("score"))).over(Window.partitionBy("fold"))
    d = a.withColumn("drop", base - F.col("score")).filter("feature <> ''")
    return d.groupBy("feature").agg(F.avg("drop").alias("mda_mean"), (F.stddev_samp("drop") / F.sqrt(F.count("*"))).alias("mda_std"))


def sfi(rows: DataFrame, splits: DataFrame, folds: int, names, **kw) -> DataFrame:
    """Out-of-fold score of each feature alone."""
    rows, splits = settle(rows, splits)
    parts = []
    for n in names:
        one = VectorAssembler(inputCols=[n], outputCol="x1").transform(rows)
        for f in range(folds):
            m = forest(of_role(one, splits, f, "train"), features="x1", **kw)
            s = predict(m, of_role(one, splits, f, "test")).withColumn("fold", F.lit(f))
            parts.append(accuracy(s).select(F.lit(n).alias("feature"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("feature").agg(F.avg("score").alias("sfi_mean"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("sfi_std"))


def consensus_rank(scores: DataFrame, cols=("mdi_mean", "mda_mean", "sfi_mean")) -> DataFrame:
    """Sum of the average-tie ranks (best first) of three scores, ranked again."""
    s = scores.withColumns({f"rank_{c}": fr.average_rank(-F.col(c), ()) for c in cols})
    s = s.withColumn("rank_sum", sum(F.col(f"rank_{c}") for c in cols))
    return s.withColumn("final_rank", fr.average_rank("rank_sum", ()))


# --- feature redundancy ----------------------------------------------------------------------


def column_ranks(df: DataFrame, keys, names, buckets: int = 256) -> DataFrame:
    """Average-tie rank of each value within its column, over the whole table.

    Values are counted per column first; approximate quantiles only place bucket
    borders, the ranks themselves are exact sums of counts.
    """
    keys, names = list(keys), list(names)
    long = df.select(*keys, *names).unpivot(keys, names, "feature", "v").filter(F.col("v").isNotNull())
    vc = long.groupBy("feature", "v").agg(F.count("*").alias("_c"))
    cuts = long.groupBy("feature").agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 1000).alias("_q"))
    vc = vc.join(cuts, "feature").withColumn("_b", F.expr("size(filter(_q, q -> q <= v))")).drop("_q")
    inside = Window.partitionBy("feature", "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = vc.groupBy("feature", "_b").agg(F.sum("_c").alias("_n")).select("feature", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    r = vc.withColumn("_up", F.sum("_c").over(inside)).join(off, ["feature", "_b"])
    r = r.select("feature", "v", (F.col("_off") + F.col("_up") - (F.col("_c") - 1) / 2.0).alias("rank"))
    return long.join(r, ["feature", "v"]).select(*keys, "feature", "rank")


def correlation_distance(df: DataFrame, keys, names) -> DataFrame:
    """(feature_a, feature_b, distance): 1 - |Spearman|, every pair in one aggregate."""
    names = list(names)
    ranks = column_ranks(df, keys, names).groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == n, F.col("rank"))).alias(n) for n in names]
    )
    cell = lambda a, b: F.struct(
        F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), fr.clip(1.0 - F.abs(F.corr(a, b)), 0.0, 1.0).alias("distance")
    )
    m = ranks.agg(F.array(*[cell(a, b) for a in names for b in names]).alias("m"))
    return m.select(F.explode("m").alias("c")).select("c.*")


def complete_linkage(d: np.ndarray, cut: float) -> list[int]:
    """Cluster labels of complete linkage below ``cut`` for a small distance matrix."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(
            ((max(d[i, j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y),
            key=lambda t: t[0],
        )
        if best[0] > cut:
            break
        _, x, y = best
        groups[x] = groups[x] + groups.pop(y)
    label = [0] * len(d)
    for k, g in enumerate(groups):
        for i in g:
            label[i] = k
    return label


def redundancy_filter(distance: DataFrame, ranks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(cluster, feature): the best-ranked feature of each cluster.

    The matrix has one row per pair of features, whatever the size of the table.
    """
    out = T.StructType([T.StructField("feature", T.StringType()), T.StructField("cluster", T.IntegerType())])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="feature_a", columns="feature_b", values="distance").sort_index()
        m = m[sorted(m.columns)]
        a = m.to_numpy(copy=True)
        np.fill_diagonal(a, 0.0)
        return pd.DataFrame({"feature": list(m.index), "cluster": complete_linkage(a, 1.0 - threshold)})

    c = distance.groupBy(F.lit(0).alias("one")).applyInPandas(cluster, out)
    return c.join(ranks.select("feature", "final_rank"), "feature").groupBy("cluster").agg(
        F.min_by("feature", F.struct("final_rank", "feature")).alias("feature"), F.count("*").alias("n_features")
    )


def rank_dataset(p: DataFrame, sigs, levels: int = 5, min_names: int = 10, close: str = "close") -> DataFrame:
    """Complete rows with a within-period grade of the next return."""
    q = p.withColumn("fwd", fr.div(fr.lead(close), close) - 1.0)
    ok = F.col("fwd").isNotNull()
    for s in sigs:
        ok = ok & F.col(s).isNotNull()
    q = q.filter(ok)
    n = F.count("*").over(fr.xs())
    q = q.withColumns({"n": n, "pos": fr.first_rank("fwd")}).filter(F.col("n") >= min_names)
    grade = F.least(F.floor(F.col("pos") / F.col("n") * levels), F.lit(levels - 1))
    return q.select("ts_ms", "symbol", *sigs, grade.cast("int").alias("grade"))

"""Detector evaluation, weight search and models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfence.operators import scoring
from skyfence.operators.timeline import US, slot_of


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def set_recall(truth: DataFrame, found: DataFrame, key: str = "bssid", samples: int = 10) -> DataFrame:
    """Counts, precision, recall and F1 of a found set against the truth, with a few misses and extras."""
    a = truth.select(F.upper(key).alias("k")).distinct().withColumn("t", F.lit(1))
    b = found.select(F.upper(key).alias("k")).distinct().withColumn("f", F.lit(1))
    flags = a.join(b, "k", "full").select("k", F.when(F.col("t").isNull(), "extra").when(F.col("f").isNull(), "missed").otherwise("hit").alias("kind"))
    counts = flags.agg(
        F.count_if(F.col("kind") == "hit").alias("true_positives"), F.count_if(F.col("kind") == "extra").alias("false_positives"),
        F.count_if(F.col("kind") == "missed").alias("false_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("k"))
    few = flags.filter("kind <> 'hit'").withColumn("_r", rank).filter(F.col("_r") <= samples)
    few = few.groupBy(F.lit(1).alias("_one")).agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("k")))), ",").alias(f"{k}_sample") for k in ("missed", "extra")
    ])
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1_score": F.round(_f1(p, r), 4), "_one": F.lit(1)}).join(
        few, "_one", "left"
    ).select("true_positives", "false_positives", "false_negatives", "precision", "recall", "f1_score", *[F.coalesce(f"{k}_sample", F.lit("")).alias(f"{k}_sample") for k in ("missed", "extra")])


def confusion(df: DataFrame, label: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts and rates of two boolean columns, optionally per group."""
    y, z = F.coalesce(F.col(label), F.lit(False)), F.coalesce(F.col(pred), F.lit(False))
    counts = df.groupBy(*by).agg(
        F.count("*").alias("total_samples"), F.count_if(y & z).alias("true_positives"), F.count_if(~y & z).alias("false_positives"),
        F.count_if(~y & ~z).alias("true_negatives"), F.count_if(y & ~z).alias("false_negatives"),
    )
    tp, fp, tn, fn, n = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives", "total_samples"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns({
        "precision": F.round(p, 4), "recall": F.round(r, 4), "f1_score": F.round(_f1(p, r), 4),
        "false_positive_rate": F.round(_ratio(fp, fp + tn), 4), "accuracy": F.round(_ratio(tp + tn, n), 4),
    })


def mttd(alerts: DataFrame, attacks: DataFrame, slot_s: int = 60) -> DataFrame:
    """Time from attack start to the first alert on its target within its span.

    ``attacks``: attack_id, bssid, start_us, end_us. Undetected attacks keep a null. Attacks and alerts meet by target and
    time slot; of a slot's alerts only the distinct instants count, so a busy target does not pair everything with everything.
    """
    inside = F.col("t_us").between(F.col("start_us"), F.col("end_us"))
    slot = lambda c: slot_of(c, slot_s * US)
    spans = attacks.filter("start_us <= end_us").withColumn("_slot", F.explode(F.sequence(slot("start_us"), slot("end_us"))))
    spots = alerts.select("bssid", "t_us", slot("t_us").alias("_slot")).distinct()
    first = spans.join(spots, ["bssid", "_slot"]).filter(inside).groupBy("attack_id").agg(F.min("t_us").alias("first_alert"))
    return attacks.join(first, "attack_id", "left").withColumn("detect_s", (F.col("first_alert") - F.col("start_us")) / 1e6)


def candidate_weights(spark, n: int = 100, seed: int = 42, keys: tuple[str, ...] = ("encryption", "rssi_norm", "vendor_risk", "ssid_suspicion", "wps_flag")) -> DataFrame:
    """n weight vectors spread evenly over the simplex (normalised exponentials), two decimals.

    Draws are md5 digits of seed, candidate and key, the same for any number of partitions and in any engine.
    """
    digits = lambda k: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"), F.lit(k)).cast("binary")), 1, 12), 16, 10)
    draws = [-F.log((digits(k).cast("double") + 0.5) / F.lit(float(1 << 48))) for k in keys]
    rows = spark.range(n).select(F.col("id").alias("candidate"), *[d.alias(k) for k, d in zip(keys, draws)])
    total = sum((F.col(k) for k in keys), F.lit(0.0))
    return rows.select("candidate", *[F.round(F.col(k) / total, 2).alias(k) for k in keys])


def weight_metrics(labelled: DataFrame, candidates: list[dict], threshold: int = 50) -> DataFrame:
    """Confusion metrics of each weight vector over all labelled rows, in one pass.

    The vectors are literals next to each row, and the counts combine before the shuffle: what
    moves is one row per vector and task. ``labelled`` needs the network columns and a boolean
    ``malicious``.
    """
    keys = [k for k in scoring.ORDER if k in scoring.WEIGHT_FEATURE]
    feats = scoring.network_features(labelled).select(F.coalesce("malicious", F.lit(False)).alias("y"), *scoring.FEATURES)
    default = {"privacy_flags": 0.05}
    vectors = F.array(*[
        F.struct(F.lit(i).alias("candidate"), *[F.lit(float(w.get(k, default.get(k, 0.0)))).alias(f"w_{k}") for k in keys])
        for i, w in enumerate(candidates)
    ])
    rows = feats.select("*", F.inline(vectors))
    base = None
    for k in keys:
        term = F.col(scoring.WEIGHT_FEATURE[k]) * F.col(f"w_{k}")
        base = term if base is None else base + term
    hit = (F.least(F.lit(1.0), base) * 0.5 * 100).cast("int") >= threshold
    y = F.col("y")
    counts = rows.withColumn("hit", hit).groupBy("candidate").agg(
        F.count_if(y & F.col("hit")).alias("tp"), F.count_if(~y & F.col("hit")).alias("fp"),
        F.count_if(y & ~F.col("hit")).alias("fn"), F.count_if(~y & ~F.col("hit")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns({"precision": p, "recall": r, "f1_score": _f1(p, r), "accuracy": _ratio(tp + tn, tp + fp + fn + tn)})


def tune_weights(labelled: DataFrame, candidates: list[dict], threshold: int = 50) -> DataFrame:
    """The vector with the best F1 (the first one on a tie)."""
    return weight_metrics(labelled, candidates, threshold).orderBy(F.col("f1_score").desc(), "candidate").limit(1)


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features_v", handleInvalid="keep").transform(df)


#: Steps of probability that ranks are told apart by.
BINS = 10_000


def _newton_sums(models: np.ndarray):
    """Partial sums of one task: for every model the Newton equations over the rows that are not of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, d = models.shape
        hessian, gradient = np.zeros((count, d, d)), np.zeros((count, d))
        for batch in batches:
            x = np.stack([np.asarray(batch.column(f"x{i}")) for i in range(d)], axis=1)
            y, n, fold = (np.asarray(batch.column(c)) for c in ("y", "n", "fold"))
            for m, w in enumerate(models):
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
                mine = np.where(fold == m, 0.0, n)  # the last model is of no fold and takes all rows
                gradient[m] += x.T @ (mine * (y - p))
                hessian[m] += (x * (mine * p * (1 - p))[:, None]).T @ x
        flat = np.concatenate([hessian.reshape(count, -1), gradient], axis=1)
        m, i = np.indices(flat.shape)
        yield pa.RecordBatch.from_arrays([pa.array(m.ravel()), pa.array(i.ravel()), pa.array(flat.ravel())], ["model", "i", "v"])

    return run


def train_risk_model(labelled: DataFrame, features: list[str], folds: int = 5, max_iter: int = 25, seed: int = 7, key: str | None = None):
    """Logistic regression on HIGH/MEDIUM = 1 with cross-validated area under the curve.

    Returns (model, mean, spread); the model is its features, coefficients and intercept. Rows equal in features, label and fold are
    one row with a count. Every step of Newton's method adds up the equations of all folds' models and of the whole one in one pass,
    and areas come from histograms of the scores. Folds are dealt by a hash of ``key``, or of the features without one, so the
    cluster's layout changes nothing; folds that lack one of the classes are not judged. A missing feature counts as 0.
    """
    from skyfence.session import shared_dir

    spark, d = labelled.sparkSession, len(features) + 1
    part = F.pmod(F.xxhash64(F.lit(seed), *([key] if key else features)), F.lit(folds)).alias("fold")
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)] + [F.lit(1.0).alias(f"x{d - 1}")]
    rows = labelled.select(*x, F.when(F.col("label").isin("HIGH", "MEDIUM"), 1.0).otherwise(0.0).alias("y"), part)
    rows = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("n"))
    path = shared_dir(spark, "risk-rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    total, models = rows.agg(F.sum("n")).first()[0] or 0.0, np.zeros((folds + 1, d))
    for _ in range(max_iter):
        sums = rows.mapInArrow(_newton_sums(models), "model bigint, i bigint, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).collect()  # a few hundred numbers
        flat = np.zeros((folds + 1, d * d + d))
        for r in sums:
            flat[r["model"], r["i"]] = r["v"]
        gradients = [f[d * d:] - 1e-6 * w for f, w in zip(flat, models)]
        steps = [np.linalg.lstsq(f[:d * d].reshape(d, d) + 1e-6 * np.eye(d), g, rcond=None)[0] for f, g in zip(flat, gradients)]
        models = models + np.array(steps)
        if max(float(s @ g) for s, g in zip(steps, gradients)) < 1e-6 * total:  # what a step still adds to the log-likelihood
            break
    score = F.lit(0.0)
    for m in range(folds):
        z = sum((F.col(f"x{i}") * F.lit(float(models[m, i])) for i in range(d)), F.lit(0.0))
        score = F.when(F.col("fold") == m, 1 / (1 + F.exp(-z))).otherwise(score)
    bins = rows.groupBy("fold", F.floor(score * BINS).alias("bin")).agg(F.sum(F.col("n") * F.col("y")).alias("ones"), F.sum("n").alias("n"))
    counted: dict[int, list] = {}
    for r in bins.orderBy("fold", "bin").collect():  # at most BINS rows a fold
        counted.setdefault(r["fold"], []).append((r["ones"], r["n"] - r["ones"]))
    scores = []
    for pairs in counted.values():
        ones, zeros = np.array(pairs).T
        if ones.sum() and zeros.sum():
            scores.append(float((ones * (np.cumsum(zeros) - zeros / 2)).sum() / (ones.sum() * zeros.sum())))
    scores = scores or [0.0]
    mean = sum(scores) / len(scores)
    model = {"features": list(features), "coefficients": models[folds, :-1].tolist(), "intercept": float(models[folds, -1])}
    return model, round(mean, 3), round((sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5, 3)


def predict_risk(df: DataFrame, model: dict, features: list[str] | None = None) -> DataFrame:
    """score (0 to 100, whole) and probability of every row, as plain column arithmetic."""
    z = F.lit(float(model["intercept"]))
    for name, w in zip(features or model["features"], model["coefficients"]):
        z = z + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(float(w))
    p = 1 / (1 + F.exp(-z))
    return df.withColumns({"score": (p * 100).cast("int"), "probability": F.round(p, 3)})


def fit_anomaly(df: DataFrame, features: list[str] | None = None, k: int = 4):
    """Principal components of normal rows: a linear auto-encoder with k hidden units."""
    from pyspark.ml.feature import PCA, StandardScaler

    features = features or scoring.FEATURES
    rows = _assemble(df, features)
    centre = StandardScaler(inputCol="features_v", outputCol="centred", withMean=True, withStd=False).fit(rows)
    pca = PCA(k=k, inputCol="centred", outputCol="hidden").fit(centre.transform(rows))
    return {"mean": [float(v) for v in centre.mean], "axes": pca.pc.toArray().tolist(), "features": features}


def score_anomaly(df: DataFrame, model: dict, threshold: float = 0.05) -> DataFrame:
    """Reconstruction error per row as plain column arithmetic; above the threshold is anomalous."""
    feats, mean, axes = model["features"], model["mean"], model["axes"]
    x = [F.col(f).cast("double") - F.lit(m) for f, m in zip(feats, mean)]
    hidden = {f"_h{j}": sum((x[i] * F.lit(float(axes[i][j])) for i in range(len(feats))), F.lit(0.0)) for j in range(len(axes[0]))}
    wide = df.withColumns(hidden)
    miss = [x[i] - sum((F.col(f"_h{j}") * F.lit(float(axes[i][j])) for j in range(len(axes[0]))), F.lit(0.0)) for i in range(len(feats))]
    loss = sum((m * m for m in miss), F.lit(0.0)) / len(feats)
    return wide.withColumn("anomaly_loss", loss).withColumn("is_anomaly", F.col("anomaly_loss") > threshold).drop(*hidden)

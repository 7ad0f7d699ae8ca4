"""Classifiers, the saved model bundle, importances and attributions.

Training uses ``pyspark.ml`` estimators (distributed tree and gradient
aggregation); the preprocessor is the fitted ``PipelineModel`` from
:func:`preprocess.fit_preprocessor`, so the bundle is one pipeline that
scores any frame with the raw feature columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prefix import running_sums
from ..session import written
from . import preprocess as PP
from . import trees as TR
from .evaluate import probability_of_class1
from .quality import columns_of


def logistic(label: str = S.TARGET, weight: str | None = "weight", n_train: int | None = None,
             max_iter: int = 1000) -> LogisticRegression:
    """O-54: L2 logistic regression equal in objective to C=1: Spark divides
    the log-loss by the total weight, so ``regParam = 1 / sum(weights)``;
    features are used unstandardised (they are already robust-scaled)."""
    reg = 1.0 / n_train if n_train else 0.0
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg,
                            elasticNetParam=0.0, standardization=False, tol=1e-6)
    return lr.setWeightCol(weight) if weight else lr


def forest(label: str = S.TARGET, weight: str | None = "weight", num_trees: int = 200, max_depth: int = 12,
           min_leaf: int = 5, seed: int = 42) -> RandomForestClassifier:
    """O-55: 200 trees, depth 12, at least 5 rows per leaf, sqrt features per
    split, bootstrap, class-balanced weights."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed,
                                cacheNodeIds=True, checkpointInterval=10)
    return rf.setWeightCol(weight) if weight else rf


def boosted(label: str = S.TARGET, weight: str | None = "weight", max_iter: int = 300, max_depth: int = 4,
            step: float = 0.05, subsample: float = 0.8, col_sample: float = 0.8, seed: int = 42) -> GBTClassifier:
    """O-56: 300 rounds of depth-4 trees, learning rate 0.05, 80 % row
    subsample, 80 % of features per split (Spark samples features per node,
    not per tree). The class weighting of either boosting library is a
    weight column: ``ratio`` (neg/pos on positives) or ``balanced``. Rows find their
    node by walking the four levels again, which costs less than a table of nodes
    that is rewritten, kept and checkpointed each pass; the trees are the same."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=str(col_sample),
                        seed=seed, cacheNodeIds=False, checkpointInterval=10)
    return gbt.setWeightCol(weight) if weight else gbt


@dataclass
class Bundle:
    """The fitted pipeline with what is needed to score: name, threshold,
    feature columns, target and the value thresholds that the features were
    derived with (O-06)."""
    name: str
    model: PipelineModel
    threshold: float = S.DEFAULT_THRESHOLD
    features: list = field(default_factory=list)
    target: str = S.TARGET
    value_thresholds: dict | None = None

    def meta(self) -> dict:
        return {"model_name": self.name, "selected_threshold": self.threshold,
                "model_features": self.features, "target_column": self.target,
                "value_thresholds": self.value_thresholds}


#: Class weighting and estimator of each kind. The two boosted kinds are the two
#: boosting models of the comparison, which differ in their weighting.
KINDS = {"logistic": "balanced", "forest": "balanced", "boosted": "ratio", "boosted_balanced": "balanced"}


#: Rows of a partition of the training matrix at least, and about at most.
TASK_ROWS, MOST_ROWS = 20_000, 500_000


def dealt(matrix: DataFrame) -> DataFrame:
    """A written table in partitions of ``TASK_ROWS`` rows or more and ``MOST_ROWS``
    or fewer: the reader cuts files by their bytes, and compressed features are so
    few bytes that a partition's rows would grow with the table. A table that is large
    enough is dealt evenly over all cores, as often as that takes: each pass of a
    learner then keeps all of them busy to its end, and there are no more partitions
    than that, since a forest's pass writes the sums of all its nodes for each."""
    rows, cores = matrix.count(), matrix.sparkSession.sparkContext.defaultParallelism
    if rows <= cores * TASK_ROWS and matrix.rdd.getNumPartitions() * MOST_ROWS >= rows:
        return matrix.coalesce(max(1, -(-rows // TASK_ROWS)))
    return matrix.repartition(cores * max(1, -(-rows // (cores * MOST_ROWS))))


def fit_bundles(train: DataFrame, kinds: Sequence[str] = tuple(KINDS), label: str = S.TARGET,
                threshold: float = S.DEFAULT_THRESHOLD, schemes: dict | None = None,
                params: dict[str, dict] | None = None) -> dict[str, Bundle]:
    """Fit one preprocessor on ``train``, write the feature matrix with its weights
    once, and fit a classifier of each kind on it. Rows without a label are left
    out. Inputs are those of the frame's schema (``preprocess.model_groups``); the
    label is never one. The matrix is ``dealt`` and persisted for Spark's learners, because they pass
    over it many times; it is kept on disk, as each learner keeps its own form of the rows in
    memory. Above ``TASK_ROWS`` rows a core, trees are grown on blocks of binned rows instead
    (:mod:`trees`), a byte a feature, shared by their kinds. The learners run side by side,
    as a round of one leaves most of a cluster idle."""
    schemes = {k: (schemes or {}).get(k) or KINDS[k] for k in kinds}
    labelled = train.where(F.col(label).isNotNull())
    groups = PP.model_groups(labelled, [*S.MODEL_EXCLUDE, label])
    weighted, weights = labelled, {}
    for scheme in sorted(set(schemes.values())):
        weights[scheme] = PP.class_weight_values(labelled, label, scheme)
        weighted = PP.class_weights(weighted, label, weights=weights[scheme], name=f"weight_{scheme}")
    pre = PP.fit_preprocessor(labelled, groups)
    table = written(pre.transform(weighted).select(
        "features", label, *[f"weight_{s}" for s in sorted(set(schemes.values()))]), "matrix")
    rows = table.count()
    large = rows > table.sparkSession.sparkContext.defaultParallelism * TASK_ROWS
    matrix, blocks, edges = dealt(table), None, []
    if not large or "logistic" in kinds:
        matrix = matrix.persist(StorageLevel.DISK_ONLY)
    if large and set(kinds) - {"logistic"}:
        # the schemes' weights are proportional, so the borders are those of either
        est = boosted()
        edges = TR.find_borders(table, rows, label, next(iter(weights.values())), est.getMaxBins(), est.getSeed())
        blocks = TR.binned(table, label, edges)

    def estimator(kind: str):
        weight, own = f"weight_{schemes[kind]}", (params or {}).get(kind, {})
        if kind == "logistic":
            return logistic(label, weight, n_train=table.agg(F.sum(weight)).first()[0], **own)
        return (forest if kind == "forest" else boosted)(label, weight, **own)

    def fitted(same: list[str]) -> list:
        """The models of kinds that are fitted together."""
        ests = [estimator(k) for k in same]
        if blocks is None or same == ["logistic"]:
            return [e.fit(matrix) for e in ests]
        if same == ["forest"]:
            return [TR.fit_forest(train.sparkSession, blocks, ests[0], edges, weights[schemes["forest"]])]
        return TR.fit_boosted(train.sparkSession, blocks, ests, edges, [weights[schemes[k]] for k in same])

    # boosted kinds that differ in their weights alone share their passes over the blocks
    together: dict = {}
    for k in kinds:
        alone = blocks is None or k in ("logistic", "forest")
        together.setdefault(k if alone else str(sorted((params or {}).get(k, {}).items())), []).append(k)
    with ThreadPoolExecutor(max(1, len(together))) as pool:
        found = list(pool.map(inheritable_thread_target(train.sparkSession)(fitted), together.values()))
    models = {k: m for same, got in zip(together.values(), found) for k, m in zip(same, got)}
    bundles = {k: Bundle(k, PipelineModel(stages=[*pre.stages, models[k]]), threshold, PP.input_columns(groups), label)
               for k in kinds}
    if blocks is not None:
        blocks.unpersist()
    matrix.unpersist()
    return bundles


def fit_bundle(train: DataFrame, kind: str = "boosted", label: str = S.TARGET,
               threshold: float = S.DEFAULT_THRESHOLD, weight_scheme: str | None = None, **params) -> Bundle:
    """Preprocessor and classifier of one kind."""
    return fit_bundles(train, [kind], label, threshold, {kind: weight_scheme}, {kind: params})[kind]


def score_all(df: DataFrame, bundles: dict[str, Bundle]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with one probability column for each bundle of one ``fit_bundles``
    call, and the columns' names by bundle: the features are computed once."""
    first = next(iter(bundles.values()))
    shared = first.model.stages[:-1]
    if any([s.uid for s in b.model.stages[:-1]] != [s.uid for s in shared] for b in bundles.values()):
        raise ValueError("the bundles do not share a preprocessor")
    out = PipelineModel(stages=shared).transform(df).select(*df.columns, "features")
    names = {k: f"probability_{k}" for k in bundles}
    for k, b in bundles.items():
        out = b.model.stages[-1].transform(out).withColumn(names[k], vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction")
    return out.drop("features"), names


def score_bundle(df: DataFrame, bundle: Bundle, threshold: float | None = None) -> DataFrame:
    """O-57 with a bundle: the input columns plus probability and class."""
    from .evaluate import score
    return score(df, bundle.model, bundle.threshold if threshold is None else threshold)


def save_bundle(bundle: Bundle, path: str) -> None:
    """O-06: the pipeline through the ML writer plus a one-row metadata
    table written next to it."""
    bundle.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(bundle.meta()),)], "meta string") \
         .coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    model = PipelineModel.load(f"{path}/model")
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    return Bundle(meta["model_name"], model, meta["selected_threshold"], meta["model_features"],
                  meta["target_column"], meta.get("value_thresholds"))


def classifier_of(bundle: Bundle):
    return bundle.model.stages[-1]


def preprocessor_of(bundle: Bundle) -> PipelineModel:
    return PipelineModel(stages=bundle.model.stages[:-1])


def feature_importance(bundle: Bundle, top: int | None = 15) -> DataFrame:
    """O-70: impurity importances of a tree model (or |coefficient| of the
    linear model) with the transformed feature names, largest first."""
    clf = classifier_of(bundle)
    names = PP.feature_names(preprocessor_of(bundle))
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in clf.coefficients.toArray().tolist()]
    spark = SparkSession.getActiveSession()
    # one row per model feature (a few dozen), built from the fitted model
    df = spark.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


def linear_attribution(scored_features: DataFrame, bundle: Bundle, top: int | None = 15) -> DataFrame:
    """O-71 / O-72 for the linear model: contribution of feature j to the
    log-odds is ``w_j (x_j - mean_j)`` (exact for a linear model with the
    data mean as baseline). Returns mean |contribution| and the direction
    (correlation of the feature value with its contribution) per feature.

    Vector statistics run through ``Summarizer`` (one distributed aggregate
    per pass); per-row arithmetic is an array ``transform`` on the JVM."""
    clf = classifier_of(bundle)
    w = clf.coefficients.toArray().tolist()
    names = PP.feature_names(preprocessor_of(bundle))
    x = scored_features.select("features")
    mean = x.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray().tolist()
    warr = F.array(*[F.lit(float(v)) for v in w])
    marr = F.array(*[F.lit(float(v)) for v in mean])
    arr = vector_to_array(F.col("features"))
    contrib = F.transform(arr, lambda v, i: warr[i] * (v - marr[i]))
    stats = x.select(
        array_to_vector(F.transform(contrib, lambda c: F.abs(c))).alias("abs_c"),
        array_to_vector(F.transform(arr, lambda v, i: (v - marr[i]) * (v - marr[i]))).alias("var_x")
    ).select(Summarizer.mean(F.col("abs_c")).alias("mac"), Summarizer.mean(F.col("var_x")).alias("vx")).first()
    mac = stats["mac"].toArray().tolist()
    vx = stats["vx"].toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = []
    for j, name in enumerate(names):
        # corr(x, w (x - m)) is sign(w) when x varies, undefined otherwise
        direction = None if vx[j] == 0 or w[j] == 0 else (1.0 if w[j] > 0 else -1.0)
        rows.append((name, float(mac[j]), direction, float(w[j])))
    df = spark.createDataFrame(rows, "feature string, mean_abs_attribution double, direction double, "
                                     "coefficient double").orderBy(F.desc("mean_abs_attribution"), "feature")
    return df.limit(top) if top else df


def attribution(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """O-71 / O-72 for given linear weights of numeric columns: mean of
    ``|w (x - mean x)|`` and the sign of the column's effect (null where the column
    is constant or the weight 0), largest first. Nulls are left out."""
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(weights)],
                   *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(weights)]).first()
    one = df.agg(*[F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.lit(means[f"m{i}"])))).alias(f"a{i}")
                   for i, (c, w) in enumerate(weights.items())])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean_abs_attribution"),
                     F.lit(None if not means[f"v{i}"] or not w else 1.0 if w > 0 else -1.0).cast("double")
                     .alias("direction")) for i, (c, w) in enumerate(weights.items())]
    return one.select(F.inline(F.array(*rows))).orderBy(F.desc_nulls_last("mean_abs_attribution"), "feature")


def penalised_gradient(matrix: DataFrame, model, label: str, weight: str) -> float:
    """Largest absolute component of the gradient of the fitted logistic
    objective (mean weighted log-loss plus the ridge term, none on the
    intercept), which is 0 at its optimum."""
    w = F.col(weight)
    error = w * (vector_to_array("probability")[1] - F.col(label))
    x = F.array_append(vector_to_array("features"), F.lit(1.0))
    sums = (model.transform(matrix).select(error.alias("e"), F.posexplode(x).alias("j", "x"))
            .groupBy("j").agg(F.sum(F.col("e") * F.col("x")).alias("g")).collect())  # one row an input
    total = matrix.agg(F.sum(w)).first()[0]
    coef = [*model.coefficients.toArray().tolist(), 0.0]
    return max(abs(r["g"] / total + model.getRegParam() * coef[r["j"]]) for r in sums)


def _scored_variants(rows: DataFrame, bundle: Bundle, numbered, hashes: list, cols: list, model_cols: list, numeric: set,
                     label: str) -> tuple[DataFrame, DataFrame]:
    """The permuted rows scored by the bundle's model, whatever it is: (feature, label,
    x, score as it is, score) of each variant; the scores of all, feature '' as they are."""
    base = bundle.model.transform(rows.drop("__one")).select(
        "__row", label, *model_cols, probability_of_class1().alias("__p0"))
    partner = numbered(hashes[0], "__at").join(rows, "__row").select(
        "__at", *[F.col(c).alias(f"__p_{c}") for c in cols])
    paired = written(base.join(numbered(hashes[1], "__at"), "__row").join(partner, "__at"), "pairs")

    def variant(c: str) -> Column:
        x = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("__feature"), x.alias("__x"),
                        *[(F.col(f"__p_{m}") if m == c else F.col(m)).alias(m) for m in model_cols])

    # as many rows a booking as there are columns to permute; the model runs once
    variants = paired.select(label, "__p0", F.explode(F.array(*map(variant, cols))).alias("__v"))
    scored = bundle.model.transform(variants.select(label, "__p0", "__v.*")).select(
        "__feature", label, "__x", "__p0", probability_of_class1().alias("__p"))
    scored = written(scored, "variants")
    return scored, scored.select("__feature", label, F.col("__p").alias("score")).union(
        paired.select(F.lit("").alias("__feature"), label, F.col("__p0").alias("score")))


def permutation_importance(test: DataFrame, bundle: Bundle, cols: list | None = None,
                           label: str = S.TARGET, key: str = S.BOOKING_ID, seed: int = 11) -> DataFrame:
    """O-71 / O-72 for any model (the tree re-aim): AUC drop when one input
    column is permuted, and the direction of its effect.

    Rows are numbered along two independent hash orders of the key by running
    sums over range blocks; a row takes the values of the row whose first number
    equals its second, so one equi-join on unique numbers gives every row its
    partner for all columns. The permutation is over the whole table and does not
    depend on how it is cut. Rows that repeat a key are partnered like others.

    Each variant (one per column) is scored once and compared with the unpermuted row's
    score. For a forest, features are made once a row and a variant takes its column's places
    from the partner's; trees that a row walks without meeting the column are not walked
    again (:func:`trees.permuted_scores`). AUCs come from one
    keyed running sum over (column, distinct score) counts, ``direction``
    (corr(x, p(x) - p(x permuted)) for numeric columns) from one aggregate.
    Rows without a label are left out."""
    cols = list(cols or bundle.features)
    model_cols = [c for c in dict.fromkeys([*bundle.features, *cols]) if c in test.columns]
    hashes = [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed + k}"))) for k in (0, 1)]
    rows = written(test.where(F.col(label).isNotNull()).select(key, label, *model_cols, F.lit(1).alias("__one"),
                                                               F.monotonically_increasing_id().alias("__row")), "rows")

    def numbered(h: Column, name: str) -> DataFrame:
        narrow = rows.select(h.alias("__h"), "__row", "__one")
        return running_sums(narrow, [F.col("__h"), F.col("__row")], ["__one"]).select(
            "__row", F.col("cum___one").alias(name))

    numeric = set(columns_of(test, "numeric"))
    forest_model = isinstance(classifier_of(bundle), RandomForestClassificationModel)
    if forest_model:
        slots = PP.slot_columns(preprocessor_of(bundle))
        places = [cols.index(c) if c in cols else -1 for c in slots]
        xs = F.struct(*[(F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias(f"x{i}")
                        for i, c in enumerate(cols)])
        # a column's places in the features depend on that column alone: permuting them permutes it
        base = written(preprocessor_of(bundle).transform(rows.drop("__one")).select(
            "__row", F.col(label).cast("double").alias("label"), xs.alias("xs"), vector_to_array("features").alias("own")), "base")
        partner = numbered(hashes[0], "__at").join(base.select("__row", F.col("own").alias("other")), "__row").drop("__row")
        paired = base.join(numbered(hashes[1], "__at"), "__row").join(partner, "__at").select("label", "xs", "own", "other")
        scored = written(TR.permuted_scores(paired, classifier_of(bundle), places, cols).withColumnRenamed("label", label), "variants")
        long = scored.select("__feature", label, F.col("__p").alias("score"))
        scored = scored.where(F.col("__feature") != "")
    else:
        scored, long = _scored_variants(rows, bundle, numbered, hashes, cols, model_cols, numeric, label)
    counts = long.groupBy("__feature", "score").agg(F.count_if(F.col(label) == 1).alias("pos"),
                                                    F.count_if(F.col(label) == 0).alias("neg"))
    cum = running_sums(counts, [F.col("__feature"), F.col("score")], ["neg"], ["__feature"], inclusive=False)
    auc = cum.groupBy("__feature").agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") * F.lit(0.5))),
                     F.sum("pos") * F.sum("neg")).alias("auc"))
    d = F.col("__p0") - F.col("__p")
    direction = scored.groupBy("__feature").agg(
        F.try_divide(F.covar_samp("__x", d), F.stddev_samp("__x") * F.stddev_samp(d)).alias("direction"))
    # one row per column plus the unpermuted one: a bounded single-partition window
    base_auc = F.max(F.when(F.col("__feature") == "", F.col("auc"))).over(Window.partitionBy(F.lit(0)))
    out = auc.withColumn("__base_auc", base_auc).where(F.col("__feature") != "").join(direction, "__feature", "left")
    return out.select(F.col("__feature").alias("feature"),
                      (F.col("__base_auc") - F.col("auc")).alias("importance"),
                      F.col("auc").alias("permuted_auc"), "direction") \
              .orderBy(F.desc_nulls_last("importance"), "feature")

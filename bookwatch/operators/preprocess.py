"""Preprocessing fitted on the training split and applied anywhere.

Fitting is a few jobs each (exact quantiles, class counts); the fitted
numbers are small and become literals in a ``SQLTransformer`` statement, so
the whole preprocessor is a saveable ``PipelineModel`` that runs JVM-side
and narrow (no shuffle) at transform time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prefix import BLOCK_ROWS
from ..functions.quantiles import quantiles
from .quality import candidate_features, check_groups, columns_of

#: Hex digits by which a block of the split is refined, and the block that is small enough to list.
DIGITS, LISTED = 3, 1000


def _round_half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def split_condition(df: DataFrame, target: str = S.TARGET, key: str = S.BOOKING_ID,
                    test_frac: float = 0.2, seed: int = 42) -> Column:
    """O-46: test-set membership for an exact stratified split; null (neither
    set) for a row without a target.

    Per class, the test set is the round(test_frac * n_class) rows with the
    smallest md5(key|seed) (ties by key): the same rows as
    ``row_number() over (partition by class order by hash, key)``, found by radix
    selection: rows are counted by the first digits of their hash, the block that
    holds the cut is counted by the next digits, and so on until it holds at most
    ``LISTED`` rows, whose hashes are listed. No class and no block is ranked in
    one task, and the driver gets at most 4096 counts a class and step. Rows
    that repeat a key stand on the same side; a row without a key is in the
    training set. The classes are few (a table of outcomes).

    The returned expression is a narrow filter with one literal cut a class."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    narrow = df.where(F.col(target).isNotNull() & F.col(key).isNotNull()).select(
        F.col(target).alias("y"), F.col(key).alias("k"), h.alias("h"))
    sizes = {r["y"]: r["n"] for r in df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("y"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    rest = {y: k for y, n in sizes.items() if (k := _round_half_up(test_frac * n)) > 0}
    prefix, cuts, size = dict.fromkeys(rest, ""), {}, dict.fromkeys(rest)

    def inside(ys) -> Column:
        found = F.lit(False)
        for y in ys:
            found = found | ((F.col("y") == F.lit(y)) & F.col("h").startswith(prefix[y]))
        return found

    while open_ := [y for y in rest if y not in cuts and (size[y] is None or size[y] > LISTED) and len(prefix[y]) < 32]:
        at = max(len(prefix[y]) for y in open_)  # all open classes are refined in step
        counts = (narrow.where(inside(open_)).groupBy("y", F.substring("h", 1, at + DIGITS).alias("b"))
                  .agg(F.count(F.lit(1)).alias("n")).collect())
        by_class: dict = {y: [] for y in open_}
        for r in counts:
            by_class[r["y"]].append((r["b"], r["n"]))
        for y in open_:
            for b, n in sorted(by_class[y]):
                if rest[y] <= n:
                    prefix[y], size[y] = b, n
                    break
                rest[y] -= n
            else:  # fewer rows with a key than the set should have: all of them
                cuts[y] = None
    listed = [y for y in rest if y not in cuts]
    if listed:
        rows = (narrow.where(inside(listed)).groupBy("y", "h", "k").agg(F.count(F.lit(1)).alias("n"))
                .orderBy("y", "h", "k").collect())
        for r in rows:
            y = r["y"]
            if y not in cuts:
                rest[y] -= r["n"]
                if rest[y] <= 0:
                    cuts[y] = (r["h"], r["k"])
    test = F.lit(False)
    for y, cut in cuts.items():
        below = F.col(key).isNotNull()
        if cut is not None:
            below = (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & (F.col(key) <= F.lit(cut[1])))
        test = test | ((F.col(target) == F.lit(y)) & F.coalesce(below, F.lit(False)))
    return F.when(F.col(target).isNotNull(), test)


def assign_split(df: DataFrame, target: str = S.TARGET, key: str = S.BOOKING_ID,
                 test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """The split as a column: ``test``, ``train``, or null without a target."""
    cond = split_condition(df, target, key, test_frac, seed)
    return df.withColumn("split", F.when(cond, "test").when(~cond, "train"))


def stratified_split(df: DataFrame, target: str = S.TARGET, key: str = S.BOOKING_ID,
                     test_frac: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """O-46: (train, test) frames of an exact stratified split."""
    cond = split_condition(df, target, key, test_frac, seed)
    return df.where(~cond), df.where(cond)


def fit_medians(train: DataFrame, cols: Sequence[str]) -> dict:
    """O-47: exact medians (linear interpolation, nulls skipped)."""
    return {c: q[0] for c, q in quantiles(train, cols, [0.5]).items()}


def impute(df: DataFrame, medians: dict) -> DataFrame:
    """O-47: replace nulls with the fitted medians (as double)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def fit_robust(train: DataFrame, cols: Sequence[str]) -> dict:
    """O-48: median and inter-quartile range per column; a zero range is
    replaced by 1 (the column is only centred), so sparse count columns are
    not erased the way ``ml.feature.RobustScaler`` erases them."""
    return {c: _robust(*q) for c, q in quantiles(train, cols, [0.25, 0.5, 0.75]).items()}


def _robust(q25: float | None, q50: float | None, q75: float | None) -> tuple[float | None, float]:
    iqr = (q75 - q25) if q25 is not None else None
    return q50, iqr if iqr not in (None, 0.0) else 1.0


def fit_imputed_robust(train: DataFrame, cols: Sequence[str]) -> tuple[dict, dict]:
    """``fit_medians``, and ``fit_robust`` of the imputed table. The values are
    counted once for both; only columns that miss some are counted again with
    their medians filled in."""
    probs = [0.25, 0.5, 0.75]
    sizes: dict[str, int] = {}
    found = quantiles(train, cols, probs, BLOCK_ROWS, sizes)
    med = {c: q[1] for c, q in found.items()}
    rows = train.count()
    missing = [c for c in cols if sizes[c] < rows]
    if missing:
        found |= quantiles(impute(train.select(*missing), {c: med[c] for c in missing}), missing, probs)
    return med, {c: _robust(*found[c]) for c in cols}


def robust_scale(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                           for c, (m, s) in params.items()})


def ordinal_expr(c: str, order: Sequence[str]) -> Column:
    """O-50: position in the given order (0-based); unknown and null give -1."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(c))
    return F.coalesce(pos - 1, F.lit(-1)).cast("int")


def ordinal_encode(df: DataFrame, orders: dict[str, Sequence[str]] = S.ORDINAL_FEATURES) -> DataFrame:
    return df.withColumns({c: ordinal_expr(c, o) for c, o in orders.items()})


def fit_one_hot(train: DataFrame, cols: Sequence[str] = tuple(S.NOMINAL_FEATURES)) -> PipelineModel:
    """O-49: all training categories in alphabetical order; a category not
    seen in training (or null) encodes to all zeros: the "keep" bucket is the
    last index and ``dropLast`` removes exactly that bucket."""
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}__idx" for c in cols],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    # the indexer's "keep" bucket is the last category; dropLast removes it
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__ohe" for c in cols],
                        dropLast=True)
    return Pipeline(stages=[idx, ohe]).fit(train)


def one_hot_categories(model: PipelineModel, cols: Sequence[str] = tuple(S.NOMINAL_FEATURES)) -> dict:
    labels = model.stages[0].labelsArray
    return {c: list(labels[i]) for i, c in enumerate(cols)}


def one_hot_long(df: DataFrame, model: PipelineModel, cols: Sequence[str] = tuple(S.NOMINAL_FEATURES),
                 key: str = S.BOOKING_ID) -> DataFrame:
    """O-49 rendered as rows: (key, feature, category) for every hot position
    of the encoded vectors; an unseen category produces no row."""
    from pyspark.ml.functions import vector_to_array
    cats = one_hot_categories(model, cols)
    enc = model.transform(df)
    parts = []
    for c in cols:
        arr = vector_to_array(F.col(f"{c}__ohe"))
        names = F.array(*[F.lit(v) for v in cats[c]])
        pos = F.array_position(arr, F.lit(1.0))
        parts.append(F.struct(F.lit(c).alias("feature"),
                              F.when((pos > 0) & (pos <= F.lit(len(cats[c]))),
                                     F.element_at(names, pos.cast("int"))).alias("category")))
    return (enc.select(F.col(key), F.inline(F.array(*parts)))
            .where(F.col("category").isNotNull()))


def class_weight_values(df: DataFrame, target: str = S.TARGET, scheme: str = "balanced") -> dict:
    """O-53: per-class weights from one conditional count.
    ``balanced``: n / (2 n_c); ``ratio``: positives n_neg / n_pos, negatives 1."""
    row = df.agg(F.count_if(F.col(target) == 0).alias("n0"), F.count_if(F.col(target) == 1).alias("n1")).first()
    n0, n1 = row["n0"], row["n1"]
    n = n0 + n1
    if scheme == "balanced":
        return {0: n / (2.0 * n0) if n0 else 0.0, 1: n / (2.0 * n1) if n1 else 0.0}
    if scheme == "ratio":
        return {0: 1.0, 1: n0 / n1 if n1 else 0.0}
    raise ValueError(scheme)


def class_weights(df: DataFrame, target: str = S.TARGET, scheme: str = "balanced",
                  weights: dict | None = None, name: str = "weight") -> DataFrame:
    """``df`` with its class's weight in ``name``; null without a target."""
    w = weights or class_weight_values(df, target, scheme)
    return df.withColumn(name, F.when(F.col(target) == 1, F.lit(w[1])).when(F.col(target) == 0, F.lit(w[0])))


# --------------------------------------------------------------------------- full preprocessor
def _sql_literal(v: float) -> str:
    return repr(float(v)) if v is not None else "CAST(NULL AS DOUBLE)"


def model_groups(df: DataFrame, exclude: Sequence[str] = tuple(S.MODEL_EXCLUDE)) -> dict[str, list[str]]:
    """O-10 / O-11: the model's input columns by treatment, from the schema of a
    feature table: every candidate column (no key, target or leakage column) but
    the excluded ones. Numbers that are no 0/1 flags are numeric. A candidate
    that is neither a number nor of a known treatment is an error: exclude it."""
    names = [c for c in candidate_features(df) if c not in exclude]
    numbers = set(columns_of(df, "numeric"))
    groups = {"numeric": [c for c in names if c in numbers and c not in S.BINARY_FEATURES],
              "nominal": [c for c in names if c in S.NOMINAL_FEATURES],
              "ordinal": [c for c in names if c in S.ORDINAL_FEATURES],
              "binary": [c for c in names if c in S.BINARY_FEATURES]}
    unused = check_groups(df.select(*names), groups)["unused"]
    if unused:
        raise ValueError(f"columns of no known treatment: {unused}")
    return groups


def input_columns(groups: dict[str, list[str]]) -> list[str]:
    return [c for cols in groups.values() for c in cols]


def fit_preprocessor(train: DataFrame, groups: dict | None = None) -> PipelineModel:
    """O-47..O-51 as one fitted ``PipelineModel``: impute + robust-scale the
    numeric group, one-hot the nominal group, ordinal-encode the ordinal
    group, pass the binary group, assemble ``features`` in that order. The groups
    are those of the frame's schema unless given."""
    g = groups or model_groups(train)
    num, nom, ordn, binr = g["numeric"], g["nominal"], g["ordinal"], g["binary"]
    med, robust = fit_imputed_robust(train, num)
    exprs = []
    for c in num:
        m, (ctr, scale) = med[c], robust[c]
        exprs.append(f"(coalesce(CAST(`{c}` AS DOUBLE), {_sql_literal(m)}) - {_sql_literal(ctr)}) "
                     f"/ {_sql_literal(scale)} AS `{c}__num`")
    for c in ordn:
        order = ", ".join("'" + v.replace("'", "''") + "'" for v in S.ORDINAL_FEATURES[c])
        exprs.append(f"CAST(coalesce(array_position(array({order}), `{c}`) - 1, -1) AS DOUBLE) AS `{c}__ord`")
    for c in binr:
        exprs.append(f"CAST(`{c}` AS DOUBLE) AS `{c}__bin`")
    sqlt = SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__")
    idx = StringIndexer(inputCols=list(nom), outputCols=[f"{c}__idx" for c in nom],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in nom], outputCols=[f"{c}__ohe" for c in nom],
                        dropLast=True)
    asm = VectorAssembler(inputCols=[f"{c}__num" for c in num] + [f"{c}__ohe" for c in nom]
                          + [f"{c}__ord" for c in ordn] + [f"{c}__bin" for c in binr],
                          outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[sqlt, idx, ohe, asm]).fit(train)


def fitted_groups(pre: PipelineModel) -> dict[str, list[str]]:
    """The input columns by treatment of a fitted preprocessor, as its assembler has them."""
    kinds = {"__num": "numeric", "__ohe": "nominal", "__ord": "ordinal", "__bin": "binary"}
    groups: dict[str, list[str]] = {k: [] for k in kinds.values()}
    for c in pre.stages[-1].getInputCols():
        groups[kinds[c[-5:]]].append(c[:-5])
    return groups


def slot_columns(pre: PipelineModel) -> list[str]:
    """The input column of each place of ``features``."""
    g = fitted_groups(pre)
    labels = [s for s in pre.stages if hasattr(s, "labelsArray")][0].labelsArray
    return [*g["numeric"], *[c for c, seen in zip(g["nominal"], labels) for _ in seen], *g["ordinal"], *g["binary"]]


def feature_names(pre: PipelineModel, strip_prefix: bool = True) -> list[str]:
    """O-52: transformed feature names in assembler order, e.g.
    ``numeric__lead_time``, ``nominal__hotel_City Hotel``; with
    ``strip_prefix`` the group prefix is removed."""
    g = fitted_groups(pre)
    labels = [s for s in pre.stages if hasattr(s, "labelsArray")][0].labelsArray
    names = [f"numeric__{c}" for c in g["numeric"]]
    for i, c in enumerate(g["nominal"]):
        names += [f"nominal__{c}_{v}" for v in labels[i]]
    names += [f"ordinal__{c}" for c in g["ordinal"]] + [f"binary__{c}" for c in g["binary"]]
    if strip_prefix:
        for p in S.TRANSFORM_PREFIXES:
            names = [n[len(p):] if n.startswith(p) else n for n in names]
    return names

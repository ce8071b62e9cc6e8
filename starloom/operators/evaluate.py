"""Confusion matrices, classification reports, scores and error analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.sizing import lookup_join

# metric entering the overall score, per class: recall of 1 to 4 stars, precision of 5 stars
SCORE_TERMS = ((1, "recall"), (2, "recall"), (3, "recall"), (4, "recall"), (5, "precision"))
# reduced-class runs, in their dense class codes ({1, 5} is coded 1, 2)
SCORE_TERMS_15 = ((1, "recall"), (2, "precision"))
# comparison across reduced-class runs, after mapping the codes back to stars
SCORE_TERMS_15_PRECISION = ((1, "precision"), (5, "precision"))
SCORE_TERMS_145 = ((1, "precision"), (4, "recall"), (5, "precision"))
SCORE_TERMS_1345 = ((1, "precision"), (3, "recall"), (4, "recall"), (5, "precision"))
EXPERIMENTAL_TERMS = ((1, "precision"), (2, "recall"), (2, "precision"), (3, "recall"), (3, "precision"),
                      (4, "recall"), (4, "precision"), (5, "precision"))


def confusion_counts(df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Observed (truth, prediction) pairs and their counts: one shuffle of pre-aggregated cells."""
    return df.groupBy(*keys, F.col(truth).cast("int").alias("truth"), F.col(prediction).cast("int").alias("prediction")).agg(
        F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, truth: str, prediction: str, n_classes: int) -> DataFrame:
    """Dense long confusion matrix; unobserved cells are zero."""
    classes = F.sequence(F.lit(1), F.lit(n_classes))
    grid = df.sparkSession.range(1).select(F.explode(classes).alias("truth")).select("truth", F.explode(classes).alias("prediction"))
    counts = confusion_counts(df, truth, prediction)
    return grid.join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(df: DataFrame, truth: str, prediction: str, n_classes: int) -> DataFrame:
    """One row per true class with one column per predicted class."""
    matrix = confusion_matrix(df, truth, prediction, n_classes)
    return matrix.groupBy("truth").agg(*[
        F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(f"predicted_{c}") for c in range(1, n_classes + 1)])


def confusion_json(df: DataFrame, truth: str, prediction: str, n_classes: int) -> DataFrame:
    """The matrix as one JSON array of arrays, the form stored in reports."""
    wide = confusion_wide(df, truth, prediction, n_classes)
    row = F.struct("truth", F.array(*[f"predicted_{c}" for c in range(1, n_classes + 1)]).alias("cells"))
    return wide.agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"])).alias("confusion_matrix"))


def class_metrics(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts; 0 where undefined."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("truth") == F.col("prediction"), n).otherwise(zero)
    roles = F.array(
        F.struct(F.col("truth").alias("label"), n.alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("label"), zero.alias("support"), n.alias("predicted"), zero.alias("hits")))
    per_class = counts.select(*keys, F.inline(roles)).groupBy(*keys, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    both = F.col("support") + F.col("predicted")
    return per_class.select(*keys, "label", precision.alias("precision"), recall.alias("recall"),
                            F.when(F.col("hits") > 0, 2 * F.col("hits") / both).otherwise(0.0).alias("f1"), "support", "hits")


def classification_report(df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per class plus 'accuracy', 'macro avg' and 'weighted avg', optionally per key.

    Everything follows from one pass over the predictions; nothing is collected.
    """
    per_class = class_metrics(confusion_counts(df, truth, prediction, keys), keys)
    grouped = per_class.groupBy(*keys) if keys else per_class.groupBy()
    total = F.sum("support")
    summary = grouped.agg(
        (F.sum("hits") / total).alias("accuracy"), total.alias("total"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")])
    nothing = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), nothing.alias("precision"), nothing.alias("recall"),
                 F.col("accuracy").alias("f1"), F.col("total").alias("support")),
        *[F.struct(F.lit(f"{kind} avg").alias("label"), F.col(f"{kind}_precision").alias("precision"), F.col(f"{kind}_recall").alias("recall"),
                   F.col(f"{kind}_f1").alias("f1"), F.col("total").alias("support")) for kind in ("macro", "weighted")])
    classes = per_class.select(*keys, F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    return classes.unionByName(summary.select(*keys, F.inline(rows)))


def report_json(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Classification report per key as the JSON object stored in run reports."""
    entry = F.when(F.col("label") == "accuracy", F.col("f1").cast("string")).otherwise(
        F.to_json(F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")))
    pair = F.concat(F.lit('"'), "label", F.lit('": '), entry)
    return report.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ", "), F.lit("}")).alias(
        "classification_report"))


def harmonic_mean(values: Sequence[Column]) -> Column:
    """n / sum(1/v); 0 as soon as one value is 0, null when one is missing."""
    any_zero = F.lit(False)
    total = F.lit(0.0)
    for v in values:
        any_zero = any_zero | (v == 0)
        total = total + F.try_divide(F.lit(1.0), v)
    return F.when(any_zero, 0.0).otherwise(F.try_divide(F.lit(float(len(values))), total))


def geometric_mean(values: Sequence[Column]) -> Column:
    """True geometric mean."""
    product = F.lit(1.0)
    for v in values:
        product = product * v
    return F.pow(product, F.lit(1.0 / len(values)))


def arithmetic_mean(values: Sequence[Column]) -> Column:
    """Plain mean (what an experimental notebook labelled geometric)."""
    return sum(values, F.lit(0.0)) / F.lit(float(len(values)))


def score_columns(terms: Sequence[tuple[int, str]]) -> list[Column]:
    """Wide report columns, e.g. ``1_recall``, behind score terms."""
    return [F.col(f"`{c}_{metric}`") for c, metric in terms]


def wide_metrics(report: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Flatten a long report to one row per key with ``<label>_<metric>`` columns."""
    names = {"precision": "precision", "recall": "recall", "f1": "f1-score", "support": "support"}
    cells = [F.max(F.when(F.col("label") == str(label), F.col(m))).alias(f"{label}_{name}") for label in labels for m, name in names.items()]
    accuracy = F.max(F.when(F.col("label") == "accuracy", F.col("f1"))).alias("accuracy")
    return (report.groupBy(*keys) if keys else report.groupBy()).agg(*cells, accuracy)


def overall_score(report: DataFrame, keys: Sequence[str] = (), terms: Sequence[tuple[int, str]] = SCORE_TERMS) -> DataFrame:
    """Harmonic mean of the chosen class metrics of a long report."""
    picked = [F.coalesce(F.max(F.when(F.col("label") == str(c), F.col(m))), F.lit(0.0)).alias(f"t{i}") for i, (c, m) in enumerate(terms)]
    wide = (report.groupBy(*keys) if keys else report.groupBy()).agg(*picked)
    return wide.select(*keys, harmonic_mean([F.col(f"t{i}") for i in range(len(terms))]).alias("eval_metric"))


# -- stored reports ---------------------------------------------------------------------------

_CLASS_ENTRY = "map<string,double>"


def parse_report(json_text: Column | str) -> Column:
    """Stored JSON report as a map label -> raw JSON value."""
    return F.from_json(json_text, "map<string,string>")


def flatten_reports(df: DataFrame, keys: Sequence[str], report: str, prefix: str = "") -> DataFrame:
    """Stored nested reports as rows (key, name, value) with names like ``1_recall``."""
    entries = df.select(*keys, F.explode(parse_report(report)).alias("label", "raw"))
    nested = F.from_json("raw", _CLASS_ENTRY)
    expanded = F.when(F.col("raw").startswith("{"), F.transform(F.map_entries(nested), lambda e: F.struct(
        F.concat_ws("_", F.col("label"), e["key"]).alias("name"), e["value"].alias("value")))).otherwise(
            F.array(F.struct(F.col("label").alias("name"), F.col("raw").cast("double").alias("value"))))
    return entries.select(*keys, F.inline(expanded)).select(*keys, F.concat(F.lit(prefix), "name").alias("name"), "value")


def widen_flat(flat: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Flat report rows back to one wide row per key; the names are given, so no extra pass."""
    return flat.groupBy(*keys).pivot("name", list(names)).agg(F.first("value"))


def remap_classes(report: Column | str, mapping: Mapping[str, str]) -> Column:
    """Rename class keys of a stored report, e.g. code 2 of a {1, 5} run to star 5."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform_keys(parse_report(report), lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def map_score(parsed: Column, terms: Sequence[tuple[int, str]] = SCORE_TERMS) -> Column:
    """Score of a parsed report map; a missing report gives null."""
    def value(label: int, metric: str) -> Column:
        return F.try_element_at(F.from_json(F.try_element_at(parsed, F.lit(str(label))), _CLASS_ENTRY), F.lit(metric))

    return harmonic_mean([value(c, m) for c, m in terms])


def enrich_reports(df: DataFrame) -> DataFrame:
    """sample_size, display_name and the scores of the stored test and training reports."""
    scored = {"sample_size": F.col("train_examples") + F.col("test_examples"),
              "eval_metric": map_score(parse_report("classification_report")),
              "display_name": F.concat("model_name", F.lit(" ("), "architecture", F.lit(")"))
              if "architecture" in df.columns else F.col("model_name")}
    if "classification_report_train" in df.columns:
        scored["eval_metric_train"] = map_score(parse_report("classification_report_train"))
    if "history" in df.columns:
        scored["network_history"] = F.coalesce("history", "network_history")
    return df.withColumns(scored)


def minority_averages(wide: DataFrame, minority: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Average minority recall and precision, and train plus predict time."""
    def mean(metric: str) -> Column:
        return arithmetic_mean([F.col(f"`{c}_{metric}`") for c in minority])

    return wide.withColumns({"minority_recall": mean("recall"), "minority_precision": mean("precision"),
                             "total_time_min": F.col("train_time_min") + F.col("predict_time_min")})


def metric_columns(columns: Sequence[str], training: bool = False) -> dict[str, list[str]]:
    """Names of the per-class F1, precision and recall columns of a wide report."""
    import re

    prefix = "train_" if training else ""
    patterns = {"f1": rf"^{prefix}\d.+score", "precision": rf"^{prefix}\d+_precision", "recall": rf"^{prefix}\d+_recall"}
    return {kind: [c for c in columns if re.search(p, c)] for kind, p in patterns.items()}


def melt_metrics(wide: DataFrame, label: str, kind: str, training: bool = False) -> DataFrame:
    """Per-class columns of one kind as rows (label, name, value)."""
    return wide.unpivot([label], metric_columns(wide.columns, training)[kind], "name", "value")


def training_history(df: DataFrame, keys: Sequence[str], history: str, series: Mapping[str, str]) -> DataFrame:
    """One row per epoch from stored JSON arrays; ``series`` maps JSON names to column names."""
    parsed = df.select(*keys, F.from_json(history, "map<string,array<double>>").alias("__h"))
    arrays = F.arrays_zip(*[F.try_element_at("__h", F.lit(k)).alias(v) for k, v in series.items()])
    rows = parsed.select(*keys, F.posexplode(arrays).alias("__e", "__z"))
    return rows.select(*keys, (F.col("__e") + 1).cast("long").alias("epoch"), *[F.col(f"__z.{v}").alias(v) for v in series.values()])


def repair_matrix_text(text: Column | str) -> Column:
    """Printed matrix ("[[1 2]\\n [3 4]]") to the JSON array of arrays; JSON input is left valid."""
    source = F.col(text) if isinstance(text, str) else text
    commas = F.regexp_replace(F.regexp_replace(source, r"[,\s]+", ","), r"\[,", "[")
    return F.regexp_replace(commas, r",\]", "]")


def matrix_rows(df: DataFrame, keys: Sequence[str], matrix: str, labels: Sequence[object]) -> DataFrame:
    """Stored JSON matrix as labelled (truth, prediction, n) rows."""
    names = F.array(*[F.lit(v) for v in labels])
    rows = df.select(*keys, F.posexplode(F.from_json(matrix, "array<array<bigint>>")).alias("__r", "__cells"))
    cells = rows.select(*keys, "__r", F.posexplode("__cells").alias("__c", "n"))
    return cells.select(*keys, F.get(names, F.col("__r")).alias("truth"), F.get(names, F.col("__c")).alias("prediction"), "n")


def failures(report: DataFrame) -> DataFrame:
    """Runs that did not succeed, with their messages."""
    return report.where(F.col("status") != "success").select("model_name", "status", "message")


# -- error analysis ---------------------------------------------------------------------------

def misclassified(df: DataFrame, truth: str, prediction: str, pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Wrongly predicted rows, optionally only the listed (truth, prediction) pairs."""
    wrong = df.where(F.col(truth) != F.col(prediction))
    if pairs is None:
        return wrong
    wanted = F.lit(False)
    for t, p in pairs:
        wanted = wanted | ((F.col(truth) == t) & (F.col(prediction) == p))
    return wrong.where(wanted)


def commonly_evaluated(df: DataFrame, truth: str, required: Mapping[int, Sequence[str]]) -> DataFrame:
    """Rows whose class-specific prediction columns are all present."""
    keep = F.lit(False)
    for label, columns in required.items():
        rule = F.col(truth) == label
        for c in columns:
            rule = rule & F.col(c).isNotNull()
        keep = keep | rule
    return df.where(keep)


def category_shares(df: DataFrame, category: str, prediction: str) -> DataFrame:
    """Rows per error category and predicted class, with the share inside the category."""
    counts = df.groupBy(category, prediction).agg(F.count("*").alias("total"))
    totals = counts.groupBy(category).agg(F.sum("total").alias("__all"))
    return counts.join(totals, category).select(category, prediction, "total", (F.col("total") / F.col("__all")).alias("percentage"))


def contributions(features: DataFrame, coefficients: DataFrame, key: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Per row, class and non-zero feature: coefficient times feature value.

    ``coefficients`` holds (feature, label, coefficient); they are folded to one row a feature, so
    that a frequent feature is spread over salted tasks where they do not fit a broadcast.
    """
    folded = coefficients.groupBy(feature).agg(F.collect_list(F.struct("label", "coefficient")).alias("__classes"))
    joined = lookup_join(features.where(F.col(value) != 0), folded, [feature]).withColumn("__class", F.explode("__classes"))
    return joined.select(key, feature, F.col("__class.label").alias("label"), (F.col(value) * F.col("__class.coefficient")).alias("contribution"))


def contribution_totals(parts: DataFrame, intercepts: DataFrame, key: str, rows: DataFrame | None = None) -> DataFrame:
    """Final linear score of every row of ``rows`` (else of ``parts``) and class: intercept plus contributions.

    A row without any weighted feature scores the intercepts alone.
    """
    classes = intercepts.agg(F.collect_list(F.struct("label", "intercept"))).scalar()
    sums = parts.groupBy(key, "label").agg(F.sum("contribution").alias("__sum"))
    every = (parts if rows is None else rows).select(key).distinct().withColumn("__class", F.explode(classes)).select(key, "__class.label", "__class.intercept")
    return every.join(sums, [key, "label"], "left").select(key, "label", (F.coalesce("__sum", F.lit(0)) + F.col("intercept")).alias("final_value"))

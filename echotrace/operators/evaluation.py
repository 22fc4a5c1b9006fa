"""How predictions compare with labels, and what judgments cost."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prediction_problems(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """`(id, problem)` of cases `(id, expected_label)` and predictions `(id, label)` that do not go together, each once."""
    known = lambda c, *labels: F.coalesce(F.col(c).isin(*labels), F.lit(False)) & (F.coalesce(F.trim("id"), F.lit("")) != "")
    told = [
        cases.where(~known("expected_label", "match", "non_match")).select("id", F.lit("case_invalid").alias("problem")),
        predictions.where(~known("label", "match", "non_match", "abstain")).select("id", F.lit("prediction_invalid").alias("problem")),
    ]
    for name, df in (("case", cases), ("prediction", predictions)):
        told.append(df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(f"{name}_repeated").alias("problem")))
    told.append(cases.select("id").join(predictions.select("id"), "id", "left_anti").select("id", F.lit("prediction_missing").alias("problem")))
    told.append(predictions.select("id").join(cases.select("id"), "id", "left_anti").select("id", F.lit("case_missing").alias("problem")))
    return reduce(DataFrame.unionByName, told).distinct()


def check_predictions(cases: DataFrame, predictions: DataFrame) -> None:
    """Raise ValueError unless every case has one prediction and none is left over."""
    if not cases.head(1):
        raise ValueError("no evaluation cases")
    problems = prediction_problems(cases, predictions).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).orderBy("problem").collect()  # a row a rule
    if problems:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']}, first id {r['id']}" for r in problems))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def metrics(cases: DataFrame, predictions: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of predictions, in one row or one for each value of `by` (columns of the cases).

    Abstentions count in no rate but their own. A rate without cases is 0.
    """
    both = cases.join(predictions.select("id", "label"), "id")
    expected, label = F.col("expected_label") == "match", F.col("label")
    count = lambda c: F.count_if(c)
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), count(label != "abstain").alias("decided"), count(label == "abstain").alias("abstained"),
        count(expected & (label == "match")).alias("true_positive"), count(~expected & (label == "match")).alias("false_positive"),
        count(~expected & (label == "non_match")).alias("true_negative"), count(expected & (label == "non_match")).alias("false_negative"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))
    out = out.withColumns({"abstention_rate": _share(F.col("abstained"), F.col("total")), "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "accuracy": _share(tp + tn, F.col("decided")), "false_positive_rate": _share(fp, fp + tn)})


def judgment_cost(input_tokens, output_tokens, input_price, output_price, surcharge=0.0) -> float:
    """The cost of one judgment; prices are for a million tokens."""
    for name, v in (("input_tokens", input_tokens), ("output_tokens", output_tokens), ("input_price", input_price), ("output_price", output_price), ("surcharge", surcharge)):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0:
            raise TypeError(f"{name} must be a finite number of at least 0")
    return input_tokens / 1_000_000 * input_price + output_tokens / 1_000_000 * output_price + surcharge


def judgment_cost_column(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float, surcharge: float = 0.0) -> Column:
    """The same over columns; null where a count is missing or below 0."""
    judgment_cost(0, 0, input_price, output_price, surcharge)
    cost = input_tokens / 1_000_000 * F.lit(float(input_price)) + output_tokens / 1_000_000 * F.lit(float(output_price)) + F.lit(float(surcharge))
    return F.when((input_tokens >= 0) & (output_tokens >= 0), cost)


def monthly_cost(cost: Column, judgments: Column, fee: float = 0.0) -> Column:
    return cost * judgments + F.lit(float(fee))

"""Evaluation: confusion, intervals, summaries, samples, hit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(0.0)


def confusion(rows: DataFrame, truth: str = "truth", said: str = "said") -> DataFrame:
    """``tp, fp, tn, fn`` of two boolean columns."""
    t, p = F.col(truth), F.col(said)
    return rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def wilson(ok: Column, n: Column, z: float = 1.96) -> Column:
    """``struct<lower, upper>`` of the score interval, in percent."""
    p = ok / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    lower = F.when(n > 0, F.round(F.greatest(F.lit(0.0), centre - margin) * 100, 2)).otherwise(0.0)
    upper = F.when(n > 0, F.round(F.least(F.lit(1.0), centre + margin) * 100, 2)).otherwise(1.0)
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def weighted(rows: DataFrame, values: list[str], weight: str) -> DataFrame:
    w = F.col(weight)
    return rows.agg(*[F.round(F.sum(F.col(v) * w) / F.greatest(F.sum(w), F.lit(1)), 4).alias(v) for v in values])


def mix(rows: DataFrame, category: str) -> DataFrame:
    """``category, n, share`` in percent."""
    counts = rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("category", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("share"))


def positions(n: int, k: int) -> list[int]:
    """``k`` places spread evenly over 1 to n, both ends among them; the middle for one."""
    if n <= 0 or k <= 0:
        return []
    if k >= n:
        return list(range(1, n + 1))
    if k == 1:
        return [n // 2 if n % 2 == 0 else (n + 1) // 2]
    return sorted({1 + round(i * (n - 1) / (k - 1)) for i in range(k)})


def threshold_midpoint(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """``group, midpoint``: half-way between the distinct values around a percentile's place."""
    d = rows.select(group, value).distinct()
    w = Window.partitionBy(group)
    d = d.withColumn("rn", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("following", F.lead(value).over(w.orderBy(value)))
    at = F.least(F.floor(F.col("n") * share) + 1, F.col("n") - 1)
    return d.filter((F.col("rn") == at) & F.col("following").isNotNull()).select(group, F.round((F.col(value) + F.col("following")) / 2, 4).alias("midpoint"))


def hits(rows: DataFrame) -> DataFrame:
    """``expected, got, seeds`` (arrays), ``mode`` -> plus ``hit``.

    exact: all expected are there; top-k: some are, and no claim or policy seed is foreign; refuse:
    nothing was found at all.
    """
    missing = F.array_except("expected", "got")
    foreign = F.filter("seeds", lambda s: (s.startswith("CLM") | s.startswith("POL")) & ~F.array_contains("expected", s))
    some = F.arrays_overlap("expected", "got")
    hit = F.when(F.col("mode") == "exact", F.size(missing) == 0).when(F.col("mode") == "top-k", some & (F.size(foreign) == 0)).otherwise((F.size("got") == 0) & (F.size("seeds") == 0))
    return rows.select("*", missing.alias("missing"), F.coalesce(hit, F.lit(False)).alias("hit"))


def severity(date, start, amount, premium, days: int = 7, times: float = 10.0, low=None) -> tuple:
    """Severity and confidence columns: by age of the policy, then by amount, then by the condition ``low``."""
    rules = [(F.datediff(date, start) <= days, "HIGH", 0.92), (amount > premium * times, "MEDIUM", 0.81), (F.lit(False) if low is None else low, "LOW", 0.60)]
    how, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for when, name, confidence in rules:
        how, sure = how.when(when, name), sure.when(when, confidence)
    return how, sure


def fraud_rules(rows: DataFrame, days: int = 7, times: float = 10.0, low=None) -> DataFrame:
    """``claim_id, start, date, amount, premium`` -> the claims that ``severity`` flags."""
    how, sure = severity(F.col("date"), F.col("start"), F.col("amount"), F.col("premium"), days, times, low)
    return rows.withColumn("severity", how).withColumn("confidence", sure).filter("severity is not null").select("claim_id", "severity", "confidence")


def profile(df: DataFrame, top: int = 5) -> DataFrame:
    """``col, value, n, distinct, rank``: the most frequent values of each string column."""
    cols = [c for c, k in df.dtypes if k == "string"]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols])).alias("x")).select("x.col", "x.value")
    counts = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("col")
    ranked = counts.withColumn("distinct", F.count("value").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("rank") <= top)


def comparison(questions: DataFrame, pruned: DataFrame, answers: DataFrame, truth: DataFrame) -> DataFrame:
    """``qid, position, claim, verdict, ground_truth, outcome``: claims of a question against labels.

    Claims named in the question come first, then kept and dropped nodes (``pruned``: ``qid, kept,
    dropped``); those without a label (``truth``: ``claim, fraud``) are left out.
    """
    j = questions.join(pruned, "qid").join(answers, "qid")
    ids = F.array_distinct(F.concat(T.claim_ids(F.col("query")), "kept", "dropped"))
    rows = j.select("qid", "answer", F.posexplode(ids).alias("position", "claim")).join(truth, "claim")
    verdict = T.verdict_for(F.col("answer"), F.col("claim"))
    return rows.select("qid", "position", "claim", verdict.alias("verdict"), F.when(F.col("fraud"), "Fraud").otherwise("Not fraud").alias("ground_truth"), T.judged(F.col("fraud"), verdict).alias("outcome"))


def claim_rows(results: DataFrame) -> DataFrame:
    """``claim_id, truth, verdict, visited, kept`` -> plus predicted and whether a flag was met and kept."""
    flag = lambda c: F.exists(c, lambda x: x.startswith("FRD-"))
    return results.select("claim_id", "truth", "verdict", (F.col("verdict") == "YES").alias("predicted"), flag("visited").alias("flag_in_subgraph"), flag("kept").alias("flag_in_pruned"))


def flag_survival(rows: DataFrame) -> DataFrame:
    """Percent of the true claims whose flag was met, and kept."""
    share = lambda c: F.coalesce(F.round(100 * F.count_if(F.col("truth") & F.col(c)) / F.nullif(F.count_if("truth"), F.lit(0)), 2), F.lit(0.0))
    return rows.agg(share("flag_in_subgraph").alias("flag_visited_pct"), share("flag_in_pruned").alias("flag_survival_pct"))


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for a seed; none for 0, all if there are fewer.

    Rows are taken in the order of a digest of seed and key.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")).cast("binary"))
    return rows.orderBy(digest, key).limit(n)


def row_position(row: Column, n: Column, head: float = 0.08, tail: float = 0.92) -> Column:
    """head, middle or tail of a file by the row's number."""
    return F.when(row <= F.greatest(F.lit(1), F.bround(head * n)), "head").when(row >= F.bround(tail * n), "tail").otherwise("middle")

"""Top-k, tiers, budgets and cumulative curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.session import input_bytes


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark cuts each partition to n before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def tier_by_repo_rank(df: DataFrame, risk: str = "risk", tie: str = "file") -> DataFrame:
    """Tiers by rank within a repository: the first tenth, quarter and half, each rounded up."""
    w = Window.partitionBy("repo")
    x = df.withColumns({"rank": F.row_number().over(w.orderBy(F.col(risk).desc(), F.col(tie).asc())), "n": F.count(F.lit(1)).over(w)})
    tier = F.lit("LOW")
    for name, share in (("MODERATE", 0.5), ("HIGH", 0.25), ("CRITICAL", 0.10)):
        tier = F.when(F.col("rank") <= F.ceil(F.lit(share) * F.col("n")), name).otherwise(tier)
    return x.withColumns({"risk_tier": tier, "risk_percentile": F.col("rank") / F.col("n")}).drop("n")


def risk_percentiles(df: DataFrame, risk: str = "risk", points=(0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """One row of exact percentiles with linear interpolation."""
    names = [f"p{round(100 * p)}" for p in points]
    cut = exact_percentiles(df, risk, points)
    return cut.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def tier_by_percentile(df: DataFrame, risk: str = "risk") -> DataFrame:
    """Tiers by the percentiles of all scores, and the flag of the upper quarter; the one row of percentiles is broadcast."""
    x = df.crossJoin(F.broadcast(risk_percentiles(df, risk)))
    r = F.col(risk)
    tier = F.when(r >= F.col("p90"), "CRITICAL").when(r >= F.col("p75"), "HIGH").when(r >= F.col("p50"), "MODERATE").otherwise("LOW")
    return x.withColumns({"risk_tier": tier, "risky": (r >= F.col("p75")).cast("int")}).drop("p10", "p25", "p50", "p75", "p90")


def average_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Percentile rank within a group, equal values sharing the mean of their ranks."""
    w = Window.partitionBy(*group)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    rank = F.rank().over(w.orderBy(value)) + (ties - 1) / 2
    return df.withColumn(name, rank / F.count(F.lit(1)).over(w))


#: Bytes of input below which a row is not looked for: inputs that small are not worth a job that counts them.
_ROW_BYTES = 32


def _band_of(risk: str, buckets: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(buckets), F.coalesce(F.floor((1 - F.col(risk)) * buckets), F.lit(buckets)))).cast("int")


def _cuts(df: DataFrame, risk: str, tie: str, buckets: int, most_rows: int) -> DataFrame | None:
    """Bands with more than ``most_rows`` rows, each with cuts (in order of rank) that part it into pieces of about that many; None if there are none.

    Cuts come from a sample by hash, of some 64 rows for each piece. They are
    rows (_b, cuts), cuts being lists of lists. Inputs of fewer bytes than
    ``_ROW_BYTES`` for each of ``most_rows`` are not counted first.
    """
    if input_bytes(df) <= most_rows * _ROW_BYTES:
        return None
    x = df.select(_band_of(risk, buckets).alias("_b"), _rank_key(risk, tie).alias("_k"), F.xxhash64(F.lit(11), risk, tie).alias("_h"))
    hot = {r["_b"]: r["n"] for r in x.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows).collect()}  # a band's row each
    if not hot:
        return None
    share = F.create_map(*[F.lit(v) for b, n in hot.items() for v in (b, min(1.0, 64 / most_rows))])
    u = F.shiftrightunsigned("_h", 11) / float(1 << 53)
    sample = x.where(F.col("_b").isin(*hot) & (u < share[F.col("_b")])).groupBy("_b", "_k").agg(F.first("_h").alias("_h"))
    at = Window.partitionBy("_b").orderBy("_k")
    picked = sample.withColumn("_r", F.row_number().over(at)).where(F.col("_r") % 64 == 0)
    step = Window.partitionBy("_b")
    root = F.ceil(F.sqrt(F.count(F.lit(1)).over(step))).cast("int")
    blocks = picked.withColumn("_g", F.floor((F.col("_r") / 64 - 1) / root).cast("int")).groupBy("_b", "_g").agg(F.sort_array(F.collect_list("_k")).alias("c"))
    return blocks.groupBy("_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("_g", "c"))), lambda x: x["c"]).alias("cuts"))


def _rank_key(risk: str, tie: str) -> Column:
    """Ascending where rows are ranked by falling risk and rising tie, nulls last."""
    return F.struct(F.coalesce(-F.col(risk).cast("double"), F.lit(float("inf"))).alias("r"), F.col(tie).alias("t"))


def running_by_risk(df: DataFrame, sums: dict[str, Column], risk: str = "risk", tie: str = "file", buckets: int = 1024, most_rows: int = 1_000_000) -> DataFrame:
    """Adds ``position`` and running sums over all rows, highest risk first.

    Rows are dealt into ``buckets`` bands of risk, which are summed side by
    side; only the bands' totals, at most one row each, meet in one task.
    Risks lie between 0 and 1; others and nulls share the outermost bands.
    A band of more than ``most_rows`` rows, as where half of all files have one
    risk, is parted further by risk and tie, at cuts that a sample gives; so no
    task gets many more rows than that, but for rows alike in both.
    """
    names = {**sums, "position": F.lit(1).cast("long")}
    x, cuts = df.withColumn("_band", _band_of(risk, buckets)), _cuts(df, risk, tie, buckets, most_rows)
    part = F.lit(0)
    if cuts is not None:  # at most one cut for every ``most_rows`` rows
        x = x.join(F.broadcast(cuts), F.col("_band") == F.col("_b"), "left").drop("_b")
        key = _rank_key(risk, tie)
        # a cut's block first, then the place in it
        block = F.size(F.filter("cuts", lambda c: c[0] <= key))
        before = F.when(block > 0, F.size(F.filter(F.get("cuts", block - 1), lambda c: c <= key)) + F.coalesce(F.aggregate(F.slice("cuts", F.lit(1), block - 1), F.lit(0), lambda s, c: s + F.size(c)), F.lit(0))).otherwise(0)
        part = F.when(F.col("cuts").isNull(), 0).otherwise(before)
    x = x.withColumn("_part", part).drop("cuts")
    totals = x.groupBy("_band", "_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in names.items()])
    before = Window.orderBy("_band", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_band").alias("_b"), F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in names])
    inner = Window.partitionBy("_band", "_part").orderBy(F.col(risk).desc(), F.col(tie).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = x.join(F.broadcast(starts), (F.col("_band") == F.col("_b")) & (F.col("_part") == F.col("_p")))
    return joined.withColumns({k: F.sum(c).over(inner) + F.col(f"_s_{k}") for k, c in names.items()}).drop("_band", "_part", "_b", "_p", *[f"_s_{k}" for k in names])


def exact_percentiles(df: DataFrame, column: str, points: Sequence[float], most_values: int = 1_000_000, bands: int = 4096) -> DataFrame:
    """One row with ``p``, the exact percentiles with linear interpolation, null on no values.

    Up to ``most_values`` rows, or ``_ROW_BYTES`` bytes of input for each of
    them, Spark's own aggregate gives them. Beyond, each
    order statistic is closed in: values between two bounds are counted in
    ``bands`` bands, and the band that holds it gives the next bounds, until
    few values are left (or one value alone); so no task holds all of them.
    """
    v = F.col(column).cast("double")
    values = df.select(v.alias("v")).where("v IS NOT NULL")
    one = values.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in points])).alias("p"))
    if input_bytes(df) <= most_values * _ROW_BYTES:
        return one
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if n <= most_values:
        return one
    ranks = sorted({r for p in points for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    found: dict[int, float] = {}
    work = [(low, high, 0, ranks)]
    while work:
        a, b, before, wanted = work.pop()
        inside = values.where(F.col("v").between(a, b))
        width = (b - a) / bands
        if a == b or width == 0 or a + width == a:
            # one value, or neighbours that no band can part
            rows = inside.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
        else:
            band = F.least(F.lit(bands - 1), F.floor((F.col("v") - a) / width)).cast("int").alias("b")
            rows = inside.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("v")).orderBy("b").collect()
        for r in rows:
            mine = [w for w in wanted if before <= w < before + r["n"]]
            if mine and ("low" not in r or r["low"] == r["v"]):
                found |= dict.fromkeys(mine, r["v"])
            elif mine:
                work.append((r["low"], r["v"], before, mine))
            before += r["n"]
    out = []
    for p in points:
        at = p * (n - 1)
        i, j = math.floor(at), math.ceil(at)
        out.append(found[i] + (found[j] - found[i]) * (at - i) if i != j else found[i])
    return df.sparkSession.createDataFrame([(out,)], "p array<double>")


def within_budget(df: DataFrame, cost: str, share: float, risk: str = "risk", tie: str = "file") -> DataFrame:
    """The riskiest rows until their cost reaches ``share`` of all cost; the row that crosses it is in."""
    total = df.agg(F.sum(cost).alias("_total"))
    x = running_by_risk(df, {"running_cost": F.col(cost)}, risk, tie).crossJoin(F.broadcast(total))
    return x.where((F.col("running_cost") - F.col(cost)) < share * F.col("_total")).drop("_total")


def budgeted_topn(df: DataFrame, n: int, budget: float | None, priority: str = "effort_priority", cost: str = "loc", tie: str = "file") -> DataFrame:
    """The n rows of highest priority, cut after the one that reaches the budget; no budget takes all n."""
    top = df.orderBy(F.col(priority).desc(), F.col(tie).asc()).limit(n)  # n rows, so one task for what follows
    w = Window.orderBy(F.col(priority).desc(), F.col(tie).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = top.withColumns({"rank": F.row_number().over(w), "cumulative_loc": F.sum(cost).over(w)})
    return x if budget is None else x.where(F.col("cumulative_loc") - F.col(cost) < budget)


def cumulative_gain(df: DataFrame, risk: str = "risk", buggy: str = "buggy", tie: str = "file") -> DataFrame:
    """Share of files against share of defects found, riskiest first."""
    total = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(buggy).alias("_bugs"))
    x = running_by_risk(df, {"found": F.col(buggy)}, risk, tie).crossJoin(F.broadcast(total))
    return x.withColumns({"files_share": F.col("position") / F.col("_n"), "bugs_share": F.when(F.col("_bugs") > 0, F.col("found") / F.col("_bugs")).otherwise(0.0)}).drop("_n", "_bugs", "found")


def rank_spread(df: DataFrame, risk: str = "risk", tie: str = "file") -> DataFrame:
    """Spreads scores that crowd at an end over ranks; blends in ranks where they hardly differ.

    More than 30 % above 0.95 or below 0.05: 0.15 + 0.8 * rank / (n - 1), rank
    from the lowest. Else with a deviation under 0.08: 0.7 * score + 0.3 * rank
    share. Else the score.
    """
    stats = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(((F.col(risk) > 0.95) | (F.col(risk) < 0.05)).cast("double")).alias("_crowd"), F.stddev_pop(risk).alias("_sd"))
    x = running_by_risk(df, {}, risk, tie).crossJoin(F.broadcast(stats))
    share = F.when(F.col("_n") > 1, (F.col("_n") - F.col("position")) / (F.col("_n") - 1)).otherwise(0.0)
    spread = F.when(F.col("_crowd") > 0.3, 0.15 + 0.8 * share).when(F.col("_sd") < 0.08, 0.7 * F.col(risk) + 0.3 * share).otherwise(F.col(risk))
    return x.withColumn("spread_risk", spread).drop("_n", "_crowd", "_sd", "position")


def distribution_expand(df: DataFrame, risk: str = "risk") -> DataFrame:
    """Scores through sigmoid(10 * (x - 0.5)) where their range is below 0.2."""
    stats = df.agg((F.max(risk) - F.min(risk)).alias("_range"))
    return df.crossJoin(F.broadcast(stats)).withColumn("expanded_risk", F.when(F.col("_range") < 0.2, 1 / (1 + F.exp(-10 * (F.col(risk) - 0.5)))).otherwise(F.col(risk))).drop("_range")


def demote_lowest_confidence(df: DataFrame, limit: float = 0.5, keep: float = 0.45) -> DataFrame:
    """Where more than ``limit`` of a repository is buggy, clears the least confident labels down to ``keep`` of it."""
    w = Window.partitionBy("repo")
    x = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_b": F.sum("buggy").over(w), "_r": F.row_number().over(w.orderBy(F.col("buggy").desc(), F.col("confidence").desc(), F.col("file").asc()))})
    clear = (F.col("_b") > limit * F.col("_n")) & (F.col("buggy") == 1) & (F.col("_r") > F.floor(F.lit(keep) * F.col("_n")))
    return x.withColumns({"adjusted_buggy": F.when(clear, 0).otherwise(F.col("buggy")), "source": F.when(clear, "adjusted").otherwise(F.when(F.col("buggy") == 1, "szz").otherwise("clean"))}).drop("_n", "_b", "_r")


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "file") -> DataFrame:
    """n rows in the order of a hash of key and seed, the same on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)


def attribution_sample(df: DataFrame, n: int, seed: int, risk: str = "risk", key: str = "file") -> DataFrame:
    """The riskiest half of the sample, and a seeded choice of the rest."""
    top = df.orderBy(F.col(risk).desc(), F.col(key).asc()).limit(n // 2)
    rest = df.join(F.broadcast(top.select(key)) if n <= 100_000 else top.select(key), key, "left_anti")
    return top.withColumn("part", F.lit("top")).unionByName(seeded_sample(rest, n - n // 2, seed, key).withColumn("part", F.lit("random")))


#: What a list of files can be sorted by: the value and whether the largest comes first; nulls count as 0.
SORTS = {"risk": ("risk", True), "commits": ("commits", True), "churn": ("churn", True), "recency": ("days_since_last_change", False)}


def sorted_list(files: DataFrame, by: str = "risk", n: int = 500, tie: str = "file") -> DataFrame:
    """The first page of ``files`` in one of the orders of ``SORTS`` (by risk for any other name), with its position; ties by ``tie``."""
    c, down = SORTS.get(by, SORTS["risk"])
    value = F.coalesce(F.col(c), F.lit(0))
    order = [value.desc() if down else value.asc(), F.col(tie).asc()]
    page = files.orderBy(*order).limit(n)  # a page of n rows
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order)))

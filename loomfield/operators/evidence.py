"""Evidence about pairs and panels: adjudication, bindings, control deltas, panels, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomfield.functions.scalars import stable_rank


def ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with their pair as left_id < right_id."""
    return rows.withColumns({"left_id": F.least(a, b), "right_id": F.greatest(a, b)})


def gathered(parts: dict[str, DataFrame]) -> DataFrame:
    """parts(left_id, right_id) by kind of evidence -> (left_id, right_id, kinds): each pair once, with
    the sorted kinds that speak for it."""
    out, kinds = None, sorted(parts)
    for kind, df in parts.items():
        one = df.select("left_id", "right_id", *[F.lit(k == kind).alias(f"_{i}") for i, k in enumerate(kinds)])
        out = one if out is None else out.union(one)
    flags = out.groupBy("left_id", "right_id").agg(*[F.max(f"_{i}").alias(f"_{i}") for i in range(len(kinds))])
    return flags.select("left_id", "right_id", F.concat_ws(",", *[F.when(F.col(f"_{i}"), k) for i, k in enumerate(kinds)]).alias("kinds"))


def adjudicated(pairs: DataFrame, exact: DataFrame, identities: DataFrame, reviews: DataFrame, geometry: DataFrame) -> DataFrame:
    """pairs(left_id, right_id) with an outcome, by the first that applies: the two are exact copies;
    they have one declared identity; a review confirms or rejects them; a review leaves them open;
    their geometry is admitted; it is not; nothing is known. identities(id, identity);
    reviews(left_id, right_id, verdict) CONFIRM, REJECT or OPEN; geometry(left_id, right_id, admitted)."""
    key = ["left_id", "right_id"]
    name = lambda side: identities.select(F.col("id").alias(f"{side}_id"), F.col("identity").alias(f"_{side}"))
    joined = (
        pairs.join(exact.select(*key).distinct().withColumn("_exact", F.lit(True)), key, "left")
        .join(name("left"), "left_id", "left")
        .join(name("right"), "right_id", "left")
        .join(reviews.select(*key, F.col("verdict").alias("_verdict")), key, "left")
        .join(geometry.select(*key, F.col("admitted").alias("_admitted")), key, "left")
    )
    outcome = (
        F.when(F.col("_exact"), "EXACT_CONFIRMED")
        .when(F.col("_left") == F.col("_right"), "SAME_IDENTITY")
        .when(F.col("_verdict") == "CONFIRM", "REVIEW_CONFIRMED")
        .when(F.col("_verdict") == "REJECT", "REVIEW_REJECTED")
        .when(F.col("_verdict").isNotNull(), "REVIEW_UNRESOLVED")
        .when(F.col("_admitted"), "GEOMETRIC_CONFIRMED")
        .when(F.col("_admitted").isNotNull(), "GEOMETRIC_UNADMITTED")
        .otherwise("UNRESOLVED")
    )
    return joined.select(*key, outcome.alias("outcome"))


def contradictions(adjudged: DataFrame, exact: DataFrame, reviews: DataFrame) -> DataFrame:
    """Exact copies that a review rejects."""
    key = ["left_id", "right_id"]
    return adjudged.join(exact.select(*key), key, "left_semi").join(reviews.filter("verdict = 'REJECT'"), key, "left_semi").select(*key)


def review_queue(adjudications: DataFrame, locations: DataFrame, distances: DataFrame) -> DataFrame:
    """adjudications(left_id, right_id, outcome) that are UNRESOLVED, with both sides' locations(id, location)
    and their distance(left_id, right_id, distance), if there is one, for a reviewer. Nothing is decided;
    near pairs come first when sorted by (distance nulls last, left_id, right_id)."""
    at = lambda side: locations.select(F.col("id").alias(f"{side}_id"), F.col("location").alias(f"{side}_location"))
    open_ = adjudications.filter("outcome = 'UNRESOLVED'").select("left_id", "right_id")
    placed = open_.join(at("left"), "left_id").join(at("right"), "right_id")
    return placed.join(distances, ["left_id", "right_id"], "left").select("left_id", "right_id", "left_location", "right_location", "distance")


def bindings(assigned: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """assigned(key, role) against registry(key, dataset): each assigned key with its dataset and a
    state: BOUND, UNREGISTERED, or CONFLICT if it is assigned to more than one role."""
    one = assigned.groupBy(key).agg(F.min("role").alias("role"), F.count_distinct("role").alias("_n"))
    state = F.when(F.col("_n") > 1, "CONFLICT").when(F.col("_known"), "BOUND").otherwise("UNREGISTERED")
    return one.join(registry.select(key, "dataset", F.lit(True).alias("_known")), key, "left").select(key, "role", "dataset", state.alias("state"))


def control_deltas(scores: DataFrame) -> DataFrame:
    """scores(panel, pair, kind, label, score): mean score of each control kind less that of the same
    pair's ORIGINAL, by label."""
    base = scores.filter("kind = 'ORIGINAL'").select("panel", "pair", F.col("score").alias("_o"))
    rest = scores.filter("kind <> 'ORIGINAL'").join(base, ["panel", "pair"])
    return rest.groupBy("panel", "kind", "label").agg(F.count("*").alias("pairs"), F.avg(F.col("score") - F.col("_o")).alias("delta"))


def panels(rows: DataFrame, identity: str, component: str, item: str, size: int, seed: str) -> DataFrame:
    """Per identity the first item in hash order for which `size` other components of the identity
    have an item: (identity, role, item, place) with the query and the first item of each of those
    components, in hash order. Smaller panels are the first places of larger ones."""
    h = stable_rank(F.lit(seed), F.col(item).cast("string"))
    one = rows.groupBy(identity, component).agg(F.min(F.struct(h.alias("h"), F.col(item).alias("item"))).alias("b"))
    own = W.partitionBy(identity)
    ranked = one.withColumn("n", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("b.h", "b.item")))
    role = F.when(F.col("r") == 1, "QUERY").otherwise("GALLERY")
    return ranked.filter((F.col("n") > size) & (F.col("r") <= size + 1)).select(
        identity, role.alias("role"), F.col("b.item").alias(item), (F.col("r") - 1).alias("place")
    )


def spaced(rows: DataFrame, identity: str, order: str, gap: int, least: int) -> DataFrame:
    """Identities' items split in time: GALLERY is the first item, QUERY all that are gap or more after
    it, if there are least of them."""
    own = W.partitionBy(identity)
    placed = rows.withColumn("_first", F.min(order).over(own)).withColumn(
        "role", F.when(F.col(order) == F.col("_first"), "GALLERY").when(F.col(order) >= F.col("_first") + gap, "QUERY")
    )
    counted = placed.withColumn("_n", F.count(F.when(F.col("role") == "QUERY", 1)).over(own))
    return counted.filter((F.col("_n") >= least) & F.col("role").isNotNull()).drop("_first", "_n")


def repeat_noise(rows: DataFrame, repeat: str, length: Column) -> DataFrame:
    """Population deviation of the logarithm of vector lengths within repeats of two or more."""
    return rows.groupBy(repeat).agg(F.count("*").alias("n"), F.stddev_pop(F.log(length)).alias("log_length_std")).filter("n > 1")


def weighted_medians(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which half of the group's weight is reached, the weighted variance about the
    weighted mean, and the count of rows with weight."""
    own = W.partitionBy(*by)
    live = rows.filter(F.col(weight) > 0)
    run = F.sum(weight).over(own.orderBy(value).rangeBetween(W.unboundedPreceding, 0))
    mean = F.sum(F.col(value) * F.col(weight)).over(own) / F.sum(weight).over(own)
    placed = live.withColumns({"_run": run, "_all": F.sum(weight).over(own), "_mean": mean})
    return placed.groupBy(*by).agg(
        F.min(F.when(F.col("_run") >= F.col("_all") / 2, F.col(value))).alias("median"),
        (F.sum(F.col(weight) * F.pow(F.col(value) - F.col("_mean"), F.lit(2))) / F.sum(weight)).alias("variance"),
        F.count("*").alias("n"),
    )


def resource_loads(stages: DataFrame, units: DataFrame) -> DataFrame:
    """stages(resource, rate, seconds), units(resource, units) -> load: busy seconds a second and unit."""
    busy = stages.groupBy("resource").agg(F.sum(F.col("rate") * F.col("seconds")).alias("busy"))
    return units.join(busy, "resource", "left").select("resource", (F.coalesce("busy", F.lit(0.0)) / F.col("units")).alias("load"))


def rescues_and_breaks(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b(query_id, rank): queries that only the second, or only the first, has at rank one."""
    both = a.select("query_id", F.col("rank").alias("ra")).join(b.select("query_id", F.col("rank").alias("rb")), "query_id")
    return both.agg(
        F.count("*").alias("queries"), F.count(F.when((F.col("ra") > 1) & (F.col("rb") == 1), 1)).alias("rescues"), F.count(F.when((F.col("ra") == 1) & (F.col("rb") > 1), 1)).alias("breaks")
    )


def stratified_blocks(blocks: list[tuple[str, dict[str, int]]], shares: dict[str, float], most: int = 1_000_000) -> dict[str, str]:
    """Blocks (name, rows by stratum), largest first, each to the role that then comes nearest to its
    share of every stratum: least total excess, then lowest fill, then the role's name. For at most `most`
    blocks, which the driver holds; splits.assembled_split() fills quotas of any number."""
    if len(blocks) > most:
        raise ValueError(f"{len(blocks)} blocks are over {most}: use splits.assembled_split()")
    totals: dict[str, int] = {}
    for _, rows in blocks:
        for s, n in rows.items():
            totals[s] = totals.get(s, 0) + n
    have: dict[str, dict[str, int]] = {r: dict.fromkeys(totals, 0) for r in shares}
    out = {}
    for name, rows in sorted(blocks, key=lambda b: (-sum(b[1].values()), b[0])):

        def cost(role: str, rows: dict[str, int] = rows) -> tuple:
            after = {s: have[role][s] + rows.get(s, 0) for s in totals}
            excess = sum(max(0.0, after[s] - shares[role] * totals[s]) for s in totals)
            return round(excess, 9), sum(have[role].values()) / max(shares[role], 1e-9), role

        best = min(shares, key=cost)
        for s, n in rows.items():
            have[best][s] += n
        out[name] = best
    return out

"""Threat catalogue: computed scores, filters, pair composition and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

from ..constants import PRIORITY_CUTS, SURFACE_CHAINS, THREAT_WEIGHTS

COMPOSITE_FAMILY = "Composite (discovered)"

CATALOGUE_SCHEMA = """
    id STRING, name STRING, family STRING, rails ARRAY<STRING>, surface STRING, summary STRING,
    genai_uplift INT, detection_gap INT, impact INT, feasibility INT, scale_velocity INT,
    kill_chain ARRAY<STRING>, observable_signals ARRAY<STRING>, mitigations ARRAY<STRING>,
    status STRING, injector STRING, parents ARRAY<STRING>
"""


def threat_score(prefix: str = "") -> Column:
    """Weighted 1-5 scales as 0-100, one decimal."""
    raw = reduce(lambda a, b: a + b, [F.col(prefix + c) * w for c, w in THREAT_WEIGHTS.items()])
    return F.round(raw / 5.0 * 100.0, 1)


def priority(score: Column) -> Column:
    (top, cut), *rest = PRIORITY_CUTS
    out = F.when(score >= cut, top)
    for name, at in rest:
        out = out.when(score >= at, name)
    return out.otherwise("watch")


def with_scores(catalogue: DataFrame) -> DataFrame:
    scored = catalogue.withColumn("threat_score", threat_score())
    return scored.withColumn("priority", priority(F.col("threat_score")))


def summary(catalogue: DataFrame) -> DataFrame:
    """Counts by family, surface, rail and priority, with totals and mean score."""
    df = with_scores(catalogue)
    one = lambda axis, c: F.struct(F.lit(axis).alias("axis"), c.alias("value"))
    axes = F.concat(
        F.array(one("family", F.col("family")), one("surface", F.col("surface")), one("priority", F.col("priority")),
                one("all", F.lit("all")), one("status", F.col("status"))),
        F.transform("rails", lambda r: one("rail", r)))
    return df.select("threat_score", F.explode(axes).alias("a")).groupBy("a.axis", "a.value").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("threat_score"), 1).alias("mean_threat_score"))


def search(
    catalogue: DataFrame, text: str | None = None, family: str | None = None, rail: str | None = None,
    status: str | None = None,
) -> DataFrame:
    df = catalogue
    if family:
        df = df.filter(F.col("family") == family)
    if rail:
        df = df.filter(F.array_contains("rails", rail))
    if status:
        df = df.filter(F.col("status") == status)
    needle = (text or "").strip().lower()
    if needle:
        hay = F.lower(F.concat("name", "id", "summary", F.concat_ws(" ", "observable_signals")))
        df = df.filter(hay.contains(needle))
    return df


def ordered(catalogue: DataFrame, by: str = "threat_score") -> DataFrame:
    """By a scale first, threat score second."""
    return catalogue.orderBy(F.desc(by), F.desc("threat_score"), "id")


# What a first stage on each surface leaves for a second one to use.
HANDED_OVER = {
    "model": "knowledge of what is let through", "onboarding": "an account in another name", "authentication": "a session that passes as the owner's",
    "authorisation": "money that has been sent", "settlement": "money that has been moved on", "dispute": "a refund that has been paid",
}
LINKS = ["one entity, device or payee in both stages", "little time between the stages"]


def seam_bonus(a: str, b: str) -> Column:
    """How much harder a pair is to see than its harder half."""
    of = lambda side, c: F.col(f"{side}.{c}")
    parts = [
        F.when(of(a, "family") != of(b, "family"), 0.35).otherwise(0.0),
        F.when(~F.arrays_overlap(of(a, "rails"), of(b, "rails")), 0.45).otherwise(0.0),
        F.when(of(a, "surface") != of(b, "surface"), 0.25).otherwise(0.0),
        F.when((of(a, "surface") == "model") | (of(b, "surface") == "model"), 0.30).otherwise(0.0),
    ]
    return F.least(reduce(lambda x, y: x + y, parts), F.lit(1.0))


def pair_candidates(catalogue: DataFrame, exclude_families: list[str] = (), chains: dict = SURFACE_CHAINS) -> DataFrame:
    """Ordered pairs in which the first stage's surface feeds the second's.

    The chain map becomes an equi-join key (one row per surface a stage can feed).
    """
    pool = with_scores(catalogue).filter(~F.col("family").isin(COMPOSITE_FAMILY, *exclude_families))
    feeds = F.create_map(*[
        x for s, to in chains.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]).cast("array<string>"))])
    a = pool.withColumn("feeds", F.explode(F.element_at(feeds, F.col("surface")))).alias("a")
    b = pool.alias("b")
    pairs = a.join(b, (F.col("a.feeds") == F.col("b.surface")) & (F.col("a.id") != F.col("b.id")))
    extra_rail = F.size(F.array_except("a.rails", "b.rails")) > 0
    pairs = pairs.filter((F.col("a.family") != F.col("b.family")) | extra_rail)
    bonus = seam_bonus("a", "b")
    fields = [c for c in catalogue.columns] + ["threat_score"]
    return pairs.select(
        F.struct(*[F.col(f"a.{c}").alias(c) for c in fields]).alias("a"),
        F.struct(*[F.col(f"b.{c}").alias(c) for c in fields]).alias("b"),
        bonus.alias("bonus"),
        (0.5 * (F.col("a.threat_score") + F.col("b.threat_score")) / 100.0 + 0.6 * bonus).alias("pre_score"))


def select_pairs(pairs: DataFrame, k: int, cap: int = 2) -> DataFrame:
    """First ``k`` pairs by pre-score in which no parent appears more than ``cap`` times.

    Equal to walking all pairs in order, but in rounds: a pair that is among the best still
    open of both its parents, within what room they have left, would be picked by the walk
    whatever comes before it, so all such pairs are picked at once. Pairs of full parents
    close. Every round picks at least the best open pair. Pairs, picks and rooms are tables;
    the driver sees one row a round. Rounds end when the first ``k`` are certain.
    """
    order = ["pre_score", "a_id", "b_id"]
    keyed = pairs.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "pre_score", *[c for c in ("a", "b", "bonus")])
    open_ = stored(keyed.select(*order), "open-pairs")
    picked: DataFrame | None = None
    by_order = [F.desc("pre_score"), F.asc("a_id"), F.asc("b_id")]
    parents = lambda df: df.select(*order, F.explode(F.array("a_id", "b_id")).alias("parent"))
    while True:
        best = F.row_number().over(Window.partitionBy("parent").orderBy(*by_order))
        ranked = parents(open_).withColumn("__r", best).filter(F.col("__r") <= cap)  # cut before the shuffle
        if picked is not None:
            used = parents(picked).groupBy("parent").agg(F.count(F.lit(1)).alias("__used"))
            ranked = ranked.join(used, "parent", "left").filter(F.col("__r") <= cap - F.coalesce("__used", F.lit(0)))
        chosen = ranked.groupBy(*order).count().filter("count = 2").drop("count")
        picked = stored(chosen if picked is None else picked.unionByName(chosen), "picked-pairs")
        full = parents(picked).groupBy("parent").count().filter(F.col("count") >= cap).select("parent")
        rest = open_.join(picked.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
        for side in ("a_id", "b_id"):
            rest = rest.join(full.withColumnRenamed("parent", side), side, "left_anti")
        open_ = stored(rest.select(*order), "open-pairs")
        best_open = open_.orderBy(*by_order).first()
        if best_open is None:
            break
        ahead = (F.col("pre_score") > best_open["pre_score"]) | (
            (F.col("pre_score") == best_open["pre_score"]) & (F.struct("a_id", "b_id") < F.struct(F.lit(best_open["a_id"]), F.lit(best_open["b_id"]))))
        if picked.filter(ahead).count() >= k:
            break
    first = picked.orderBy(*by_order).limit(k)
    numbered = first.withColumn("pick", F.row_number().over(Window.orderBy(*by_order)))  # k rows
    return keyed.join(F.broadcast(numbered.drop("pre_score")), ["a_id", "b_id"])


def _scale(c: Column) -> Column:
    """Round half to even, clipped to 1..5."""
    return F.least(F.greatest(F.bround(c), F.lit(1)), F.lit(5)).cast("int")


def composed_scales(pairs: DataFrame) -> DataFrame:
    """The five scales of each pair taken together."""
    hi = lambda c: F.greatest(f"a.{c}", f"b.{c}")
    lo = lambda c: F.least(f"a.{c}", f"b.{c}")
    return pairs.withColumns({
        "genai_uplift": _scale(hi("genai_uplift")),
        "detection_gap": _scale(hi("detection_gap") + F.col("bonus")),
        "impact": _scale(hi("impact") + 0.4 * lo("impact") / 5.0 * 2),
        "feasibility": _scale(lo("feasibility") - 0.8),
        "scale_velocity": _scale(lo("scale_velocity") - 0.3),
    })


def compose(selected: DataFrame) -> DataFrame:
    """Composite records of the selected pairs, numbered by threat score.

    Between the stages stands what the first one hands over; the signals end with those
    that only show when both stages are looked at together.
    """
    gains = F.create_map(*[F.lit(x) for kv in HANDED_OVER.items() for x in kv])
    handed = F.concat(F.lit("[hand-off] "), F.coalesce(gains[F.col("a.surface")], F.lit("the result of the first stage")))
    selected = composed_scales(selected)
    first_last = lambda side, n: F.transform(
        F.array(F.element_at(f"{side}.kill_chain", 1), F.element_at(f"{side}.kill_chain", -1)),
        lambda s: F.concat(F.lit(f"[stage {n}: "), F.col(f"{side}.id"), F.lit("] "), s))
    out = selected.select(
        "pick",
        F.concat_ws(" → ", "a.name", "b.name").alias("name"),
        F.lit(COMPOSITE_FAMILY).alias("family"),
        F.array_union("a.rails", "b.rails").alias("rails"),
        F.col("b.surface").alias("surface"),
        F.concat_ws(" ", F.lit("Two stages:"), F.lower("a.name"), F.lit("hands over to"), F.lower("b.name")).alias("summary"),
        "genai_uplift", "detection_gap", "impact", "feasibility", "scale_velocity",
        F.concat(first_last("a", 1), F.array(handed), first_last("b", 2)).alias("kill_chain"),
        F.array_distinct(F.concat(F.slice("a.observable_signals", 1, 3), F.slice("b.observable_signals", 1, 3), F.array(*[F.lit(x) for x in LINKS])))
        .alias("observable_signals"),
        F.array_distinct(F.concat(F.slice("a.mitigations", 1, 1), F.slice("b.mitigations", 1, 1))).alias("mitigations"),
        F.lit("discovered").alias("status"), F.lit(None).cast("string").alias("injector"),
        F.array("a.id", "b.id").alias("parents"), "bonus", "pre_score",
    )
    scored = with_scores(out)
    # Never more than k rows get here, so one ordered window is fine.
    number = F.row_number().over(Window.orderBy(F.desc("threat_score"), "pick"))
    return scored.withColumn("id", F.format_string("HYB-%02d", number)).drop("pick")


def compose_pairs(catalogue: DataFrame, k: int = 10, cap: int = 2, exclude_families: list[str] = ()) -> DataFrame:
    return compose(select_pairs(pair_candidates(catalogue, exclude_families), k, cap))


def coverage(catalogue: DataFrame, implemented: DataFrame, exempt: list[str] = ()) -> DataFrame:
    """Ids that are marked simulated but not implemented, or the other way round."""
    want = catalogue.filter((F.col("status") == "simulated") & ~F.col("id").isin(*exempt)).select("id", F.lit(1).alias("marked"))
    have = implemented.select("id").distinct().withColumn("present", F.lit(1))
    return want.join(have, "id", "full_outer").filter("marked IS NULL OR present IS NULL").select(
        "id", F.when(F.col("marked").isNull(), "unmarked").otherwise("unimplemented").alias("problem"))


def sample_catalogue(spark: SparkSession) -> DataFrame:
    """A handful of generic entries for documentation and tests."""
    rows = [
        ("S-01", "Coerced transfer", "coercion", ["upi_p2p", "card_cnp"], "authorisation", "Victim is talked into paying",
         4, 4, 5, 4, 3, ["contact", "pressure", "payment"], ["long call", "new payee"], ["cooling-off"], "simulated", "coerce", []),
        ("S-02", "Relay account", "mule", ["upi_p2p", "wallet"], "settlement", "Funds forwarded at once",
         2, 4, 4, 4, 4, ["credit", "split", "debit"], ["short dwell"], ["hold funds"], "simulated", "relay", []),
        ("S-03", "Borrowed identity", "identity", ["card_cnp"], "onboarding", "Account opened on stolen papers",
         5, 3, 3, 3, 4, ["forge", "open"], ["reused papers"], ["liveness check"], "documented", None, []),
        ("S-04", "Code interception", "takeover", ["upi_p2p", "card_cnp"], "authentication", "One-time code captured",
         3, 3, 4, 4, 4, ["lure", "capture", "login"], ["new device"], ["passkeys"], "simulated", "code", []),
        ("S-05", "Boundary probing", "probing", ["card_cnp", "agentic"], "model", "Small payments map the limits",
         5, 5, 3, 3, 3, ["probe", "learn"], ["regular amounts"], ["rate limits"], "documented", None, []),
        ("S-06", "Dispute abuse", "first_party", ["card_cnp"], "dispute", "Goods kept, payment disputed",
         2, 3, 2, 5, 2, ["buy", "dispute"], ["dispute history"], ["evidence file"], "simulated", "dispute", []),
    ]
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)

"""The county episode panel and its state rollup, from storm records to labelled rows.

Every enricher is a join that returns a new DataFrame; windows over daily series
are equality joins on (county, day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.classify import first_matching, season
from gaugeworks.operators.joins import overlap_first_match, window_values

# Event types by family, miles an hour in a knot, water in snow.
WIND = ["Thunderstorm Wind", "High Wind", "Strong Wind"]
FLOOD = ["Flash Flood", "Flood", "Heavy Rain", "Debris Flow"]
WINTER = ["Winter Storm", "Heavy Snow", "Blizzard", "Ice Storm", "Winter Weather", "Lake-Effect Snow"]
MPH, SNOW_WATER, COLD_MONTHS = 1.151, 0.30, (12, 1, 2, 3, 4)
_SPAN = ["fips", "begin", "end"]


def _spans(panel: DataFrame) -> DataFrame:
    """Each county, begin and end of any episode once: what is looked up by dates is looked up for these."""
    return panel.select(*_SPAN).distinct()


def _told(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """The panel with what was found for its episodes' spans; one key for all lookups, so the panel is dealt once."""
    new = [c for c in spans.columns if c not in _SPAN]
    return panel.join(spans, _SPAN, "left").select(*panel.columns, *new)


def county_rows(storms: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Storm records by county: county rows as they are, zone rows of flood and winter types once for each member, damage split."""
    own = storms.where("zone_type = 'C'").withColumn("fips", F.concat("state", "zone")).withColumn("zoned", F.lit(False))
    zones = storms.where("zone_type = 'Z'").where(F.col("event_type").isin(FLOOD + WINTER)).withColumn("zone_key", F.concat("state", "zone"))
    size = crosswalk.groupBy("zone_key").agg(F.count("fips").alias("members"))
    spread = zones.join(crosswalk, "zone_key").join(size, "zone_key").withColumn("damage", F.col("damage") / F.col("members")).withColumn("zoned", F.lit(True))
    return own.unionByName(spread.select(own.columns))


def episodes(rows: DataFrame) -> DataFrame:
    """One row for each county and episode, all measures in one aggregation; rows without a date drop out."""
    kind, mph = F.col("event_type"), F.col("magnitude") * MPH
    wind = kind.isin(WIND) & (F.col("magnitude") != 0)
    sustained = F.col("magnitude_type").isin("ES", "MS")
    return (
        rows.groupBy("fips", "state", "episode")
        .agg(
            F.min("begin_date").alias("begin"),
            F.max("begin_date").alias("end"),
            F.sort_array(F.collect_set("event_type")).alias("types"),
            F.bround(F.coalesce(F.max(F.when(wind & ~F.coalesce(sustained, F.lit(False)), mph)), F.lit(0.0))).cast("int").alias("gust"),
            F.bround(F.coalesce(F.max(F.when(wind & sustained, mph)), F.lit(0.0))).cast("int").alias("sustained"),
            F.bround(F.coalesce(F.max(F.when(kind == "Hail", F.col("magnitude"))), F.lit(0.0)), 2).alias("hail"),
            F.count_if(kind == "Tornado").alias("tornadoes"),
            F.coalesce(F.max(F.when(kind == "Tornado", F.col("scale"))), F.lit(-1)).alias("ef"),
            F.bool_or(kind.isin(FLOOD)).alias("flood"),
            F.bool_or(kind.isin(WINTER)).alias("winter"),
            F.bool_or("zoned").alias("zoned"),
            F.bround(F.sum("damage")).cast("long").alias("damage"),
        )
        .where("begin is not null")
    )


def declared(panel: DataFrame, incidents: DataFrame, before: int = 10, after: int = 4) -> DataFrame:
    """The panel with ``declared``, ``dn`` and ``cost`` of the highest-numbered incident of the county that overlaps.

    ``incidents``: (fips, dn, incident_begin, incident_end, cost).  An incident
    overlaps when it begins by ``after`` days past the episode and ends no more
    than ``before`` days ahead of it.
    """
    mine, theirs = (F.date_sub("begin", before), F.date_add("end", after)), (F.col("incident_begin"), F.col("incident_end"))
    found = overlap_first_match(_spans(panel), incidents, ["fips"], _SPAN, mine, theirs, F.col("dn"), ["dn", "cost"])
    return _told(panel, found).withColumn("declared", F.col("dn").isNotNull().cast("int"))


def with_rain(panel: DataFrame, rain: DataFrame) -> DataFrame:
    """Peak day, event total and 7- and 14-day antecedent rain; ``rain``: (fips, day, mean, most).  Missing days count as 0."""
    during = window_values(_spans(panel), rain, ["fips"], "begin", "end", "day", before=14)
    inside, days = F.col("day") >= F.col("begin"), F.datediff("begin", "day")

    def total(test: Column) -> Column:
        return F.bround(F.coalesce(F.sum(F.when(test, F.col("mean"))), F.lit(0.0)), 2)

    sums = during.groupBy(*_SPAN).agg(
        F.bround(F.max(F.when(inside, F.col("most"))), 2).alias("rain_day_max"), total(inside).alias("rain_event"), total(days.between(1, 7)).alias("rain_before_7"), total(days.between(1, 14)).alias("rain_before_14"), F.count_if(inside).alias("rain_days_seen")
    )
    return _told(panel, sums)


def with_snow(panel: DataFrame, depth: DataFrame) -> DataFrame:
    """Deepest snow of the two weeks before and the largest one-day melt; 0 outside the cold months, null where unobserved.

    ``depth``: (fips, day, depth), the largest of the county's stations.
    """
    cold = _spans(panel.where(F.month("begin").isin(*COLD_MONTHS)))
    seen = window_values(cold, depth, ["fips"], "begin", "end", "day", before=14)
    after = seen.select(*_SPAN, F.date_sub("day", 1).alias("day"), F.col("depth").alias("next"))
    pairs = seen.join(after, [*_SPAN, "day"], "left")
    melt = F.when(F.col("day") >= F.date_sub("begin", 4), F.greatest(F.col("depth") - F.col("next"), F.lit(0.0)))
    sums = pairs.groupBy(*_SPAN).agg(F.max(F.when(F.col("day") < F.col("begin"), F.col("depth"))).alias("d"), F.max(melt).alias("m"))
    is_cold = F.month("begin").isin(*COLD_MONTHS)
    joined = _told(panel, sums)
    depth_, melt_ = (F.when(is_cold, F.bround(c, 1)).otherwise(F.lit(0.0)) for c in ("d", "m"))
    return joined.withColumns({"snow_depth_before": depth_, "snow_melt": melt_}).withColumns({"water_before": F.bround(F.col("snow_depth_before") * SNOW_WATER, 2), "water_melt": F.bround(F.col("snow_melt") * SNOW_WATER, 2)}).drop("d", "m")


def state_panel(panel: DataFrame, order: str = "fips") -> DataFrame:
    """One row for each state and episode; missing measures count as 0; ``dn`` is the most frequent one, first seen on ties."""
    over = F.col("flood") | (F.col("ef") >= 1) | (F.col("gust") >= 60) | (F.col("hail") >= 1)
    group = ["state", "episode"]
    # dealt once; counts by incident first, as the most frequent one is asked for
    dealt = panel.withColumn("_order", F.col(order).cast("long")).repartition(*group)
    by_dn = dealt.groupBy(*group, "dn").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("counties"), F.count_if(over).alias("counties_over"), F.sum("damage").alias("damage"),
        F.sum("tornadoes").alias("tornadoes"), F.max("ef").alias("ef"), F.max(F.coalesce("gust", F.lit(0))).alias("gust"), F.max(F.coalesce("hail", F.lit(0.0))).alias("hail"),
        F.count_if("flood").alias("n_flood"), F.count_if("winter").alias("n_winter"), F.count_if(F.col("tornadoes") > 0).alias("n_tornado"), F.count_if(F.col("gust") > 0).alias("n_wind"), F.count_if(F.col("hail") > 0).alias("n_hail"),
        F.min("_order").alias("_seen"),
    )
    sums = ("counties", "counties_over", "damage", "tornadoes", "n_flood", "n_winter", "n_tornado", "n_wind", "n_hail")
    often = F.when(F.col("dn").isNotNull(), F.struct("counties", -F.col("_seen")))
    main = by_dn.groupBy(*group).agg(F.min("begin").alias("begin"), *(F.max(c).alias(c) for c in ("end", "ef", "gust", "hail")), *(F.sum(c).alias(c) for c in sums), F.max_by("dn", often).alias("dn"))
    scores: Sequence[tuple[str, str]] = (("n_flood", "Flood"), ("n_tornado", "Tornado"), ("n_winter", "Winter"), ("n_wind", "Wind"), ("n_hail", "Hail"))
    top = F.greatest(*(c for c, _ in scores))
    incident = first_matching([((F.col(c) == top) & (top > 0), v) for c, v in scores], "Severe Storm")
    joined = main.withColumns({"incident": incident, "season": season(F.month("begin"))})
    columns = ("begin", "end", "counties", "counties_over", "damage", "tornadoes", "ef", "gust", "hail", "incident", "season", "dn")
    return joined.select(*group, *columns).withColumn("declared", F.col("dn").isNotNull().cast("int"))

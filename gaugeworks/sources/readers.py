"""Readers of landed files, each with its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.parsing import compact_date, money, number, pad_code, tornado_scale

STORM_COLUMNS = ["STATE_FIPS", "CZ_TYPE", "CZ_FIPS", "CZ_NAME", "EVENT_TYPE", "EPISODE_ID", "BEGIN_YEARMONTH", "BEGIN_DAY", "MAGNITUDE", "MAGNITUDE_TYPE", "TOR_F_SCALE", "DAMAGE_PROPERTY"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without zone become dates where queries ask for days."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def storm_events(spark: SparkSession, paths: str | list[str], states: list[str] | None = None) -> DataFrame:
    """Storm event CSV (gzip), Latin-1, columns found by header; one task a file, so rows are dealt anew."""
    rows = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE").csv(paths)
    return storm_rows(rows, states).repartition("state", "episode")


def storm_rows(rows: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Typed storm events of text columns named as in the files; with ``states``, of these states' codes only."""
    rows = rows.select(*STORM_COLUMNS)
    if states:
        rows = rows.where(pad_code(F.col("STATE_FIPS"), 2).isin(states))
    return rows.select(
        pad_code(F.col("STATE_FIPS"), 2).alias("state"),
        F.col("CZ_TYPE").alias("zone_type"),
        pad_code(F.col("CZ_FIPS"), 3).alias("zone"),
        F.initcap(F.trim("CZ_NAME")).alias("zone_name"),
        F.trim("EVENT_TYPE").alias("event_type"),
        F.col("EPISODE_ID").try_cast("long").alias("episode"),
        compact_date(F.col("BEGIN_YEARMONTH"), F.col("BEGIN_DAY")).alias("begin_date"),
        number(F.col("MAGNITUDE")).alias("magnitude"),
        F.col("MAGNITUDE_TYPE").alias("magnitude_type"),
        tornado_scale(F.col("TOR_F_SCALE")).alias("scale"),
        money(F.col("DAMAGE_PROPERTY")).alias("damage"),
    )


def zone_counties(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited crosswalk: (zone_key, fips), both of the right length and of one state."""
    names = "STATE string, ZONE string, CWA string, NAME string, STATE_ZONE string, COUNTY string, FIPS string, TIME_ZONE string, FE_AREA string, LAT string, LON string"
    return crosswalk(spark.read.option("sep", "|").schema(names).csv(path))


def crosswalk(rows: DataFrame) -> DataFrame:
    """(zone_key, fips) of crosswalk rows whose zone and county codes have five characters and one state."""
    key, fips = F.trim("STATE_ZONE"), F.trim("FIPS")
    return rows.select(key.alias("zone_key"), fips.alias("fips"), F.trim("STATE").alias("state")).where((F.length("fips") == 5) & (F.length("zone_key") == 5) & F.col("zone_key").startswith(F.col("state"))).select("zone_key", "fips").distinct()


def rdb(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with ``#`` comments, a header and a row of column formats such as ``10s``, which is left out."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema(schema).csv(path)
    first = rows.columns[0]
    return rows.where(~F.col(first).rlike(r"^\d+[sdn]$"))


def rdb_documents(rows: DataFrame, schema: str, document: str = "document") -> DataFrame:
    """Landed tab-separated documents, one a row: comments, the header and the row of formats go; other columns stay."""
    lines = F.filter(F.split(document, "\\r?\\n"), lambda x: ~x.startswith("#") & (F.trim(x) != ""))
    body = F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))
    parsed = rows.withColumn("_line", F.explode(body)).withColumn("_r", F.from_csv("_line", schema, {"sep": "\t"}))
    return parsed.drop(document, "_line").select("*", "_r.*").drop("_r")


def station_days(rows: DataFrame, county: str = "fips", start: str = "sdate", stations: str = "stations") -> DataFrame:
    """(fips, station, day, value): arrays of daily values dated from their start; M and S are null, T is 0."""
    each = rows.select(county, start, F.posexplode(stations).alias("station", "values")).select(county, start, "station", F.posexplode("values").alias("k", "text"))
    value = F.when(F.upper("text").startswith("T"), F.lit(0.0)).otherwise(number(F.regexp_replace("text", "[A-Z]$", ""), None))
    return each.select(county, "station", F.date_add(F.col(start).cast("date"), F.col("k")).alias("day"), value.alias("value"))


def gauge_series(rows: DataFrame, document: str = "document", least: float = -999999.0, most: float = 75.0) -> DataFrame:
    """(site, day, value) of nested water-service JSON; sentinels and reservoir levels are left out."""
    schema = "struct<value:struct<timeSeries:array<struct<sourceInfo:struct<siteCode:array<struct<value:string>>>,values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>>"
    series = rows.select(F.explode(F.from_json(document, schema)["value"]["timeSeries"]).alias("s"))
    points = series.select(F.col("s.sourceInfo.siteCode")[0]["value"].alias("site"), F.explode("s.values").alias("v")).select("site", F.explode("v.value").alias("p"))
    return points.select("site", F.to_date(F.substring("p.dateTime", 1, 10)).alias("day"), number(F.col("p.value"), None).alias("value")).where((F.col("value") > least) & (F.col("value") <= most))


def header_array(rows: DataFrame, document: str = "document") -> DataFrame:
    """(row, column, value) of a JSON array of arrays whose first row names the columns."""
    parsed = rows.select(F.from_json(document, "array<array<string>>").alias("a"))
    body = parsed.select(F.get("a", F.lit(0)).alias("h"), F.posexplode("a").alias("row", "r")).where("row > 0")
    return body.select("row", F.explode(F.arrays_zip("h", "r")).alias("c")).select("row", F.col("c.h").alias("column"), F.col("c.r").alias("value"))


def fresh_keys(wanted: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """Keys that were not landed yet: what a resumed pull still has to fetch."""
    return wanted.join(landed.select(key).distinct(), key, "left_anti")


def gridded_days(rows: DataFrame, document: str = "document") -> DataFrame:
    """(fips, day, mean, most) of JSON rows ``[day, {fips: mean}, {fips: most}]``; a county without a mean drops out."""
    each = rows.select(F.explode(F.from_json(document, "array<array<string>>")).alias("r"))
    maps = each.select(F.col("r")[0].cast("date").alias("day"), *(F.from_json(F.col("r")[k], "map<string,double>").alias(n) for k, n in ((1, "means"), (2, "peaks"))))
    # both maps in one pass by hash: a lookup in a map goes through all its keys
    means, peaks = F.transform_values("means", lambda _, v: F.struct(v.alias("mean"))), F.coalesce("peaks", F.from_json(F.lit("{}"), "map<string,double>"))
    found = maps.select("day", F.explode(F.map_zip_with(means, peaks, lambda _, m, p: F.struct(m.alias("m"), p.alias("most")))).alias("fips", "v"))
    return found.where("v.m is not null").select("fips", "day", "v.m.mean", "v.most")


def field_names(rows: DataFrame, document: str = "document") -> DataFrame:
    """(name) of every ``"name"`` anywhere in a JSON field dictionary, however deep."""
    return rows.select(F.explode(F.regexp_extract_all(document, F.lit(r'"name"\s*:\s*"([^"]*)"'), F.lit(1))).alias("name"))


def features(rows: DataFrame, attributes: str, document: str = "document") -> DataFrame:
    """Attributes of landed feature-service pages and ``more``: whether the service holds further pages; other columns stay."""
    schema = f"struct<features:array<struct<attributes:struct<{attributes}>>>,exceededTransferLimit:boolean>"
    page = rows.withColumn("_p", F.from_json(document, schema)).drop(document)
    each = page.withColumn("more", F.coalesce("_p.exceededTransferLimit", F.lit(False))).withColumn("_f", F.explode("_p.features"))
    return each.select("*", "_f.attributes.*").drop("_p", "_f")


def polygon_rings(rows: DataFrame, document: str = "document") -> DataFrame:
    """(ring, points): the rings of GeoJSON polygons and multipolygons in their order; other shapes have none, other columns stay."""
    kind, text = F.get_json_object(document, "$.type"), F.get_json_object(document, "$.coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    each = rows.select("*", F.posexplode(rings).alias("ring", "_c")).drop(document)
    return each.withColumn("points", F.transform("_c", lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))).drop("_c")


def document_link(link: Column) -> Column:
    """A link that ends in ``.pdf``, appended where it is missing."""
    return F.when(F.lower(link).endswith(".pdf"), link).otherwise(F.concat(link, F.lit(".pdf")))


def listed(path: Column, own: list[str]) -> Column:
    """Whether a listing shows a file: its name does not start with ``_`` and is none of ``own``."""
    name = F.element_at(F.split(path, "/"), -1)
    return ~(name.startswith("_") | name.isin(own))

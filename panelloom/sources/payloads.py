"""Parsers of captured payloads: raw text in a column to rows, as DataFrame transforms.

Every parser takes a DataFrame with the payload in column ``payload`` (and keys that it keeps) and drops what doesn't
parse; nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number as sources write it: thousands commas dropped; '', '.', '---', None and NA are null."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(~F.lower(bare).isin("", ".", "---", "none", "na", "n/a", "nan"), bare).try_cast("double")


def period_start(text: Column) -> Column:
    """First day of '2005-Q1', '2005Q1', '2005-01', '2005' or '2005-01-31' (that day itself)."""
    year = F.substring(text, 1, 4)
    quarter = F.regexp_extract(text, r"^\d{4}-?Q([1-4])$", 1)
    month = F.regexp_extract(text, r"^\d{4}-(\d{2})$", 1)
    out = F.when(quarter != "", F.concat(year, F.lit("-"), F.lpad((quarter.try_cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("-01")))
    out = out.when(month != "", F.concat(year, F.lit("-"), month, F.lit("-01"))).when(text.rlike(r"^\d{4}$"), F.concat(year, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10))
    return out.try_cast("date")


# --- filings ---------------------------------------------------------------------------------------------------------

#: The forms whose facts count.
FORMS = ("10-K", "10-Q")


def company_facts(raw: DataFrame, keys: list[str], taxonomy: str = "us-gaap", tags: list[str] | None = None, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """Company-facts JSON to (*keys, tag, unit, event_date, pub_date, value, form_type, period): facts -> taxonomy -> tag -> units -> observations."""
    obs = "struct<end:string,filed:string,val:double,form:string,fp:string,fy:int>"
    schema = f"struct<facts:map<string,map<string,struct<units:map<string,array<{obs}>>>>>>"
    x = raw.select(*keys, F.explode(F.element_at(F.from_json("payload", schema)["facts"], taxonomy)).alias("tag", "body"))
    if tags:
        x = x.where(F.col("tag").isin(tags))
    x = x.select(*keys, "tag", F.explode("body.units").alias("unit", "rows")).select(*keys, "tag", "unit", F.explode("rows").alias("o"))
    good = F.col("o.end").isNotNull() & F.col("o.filed").isNotNull() & F.col("o.val").isNotNull() & F.col("o.form").isin(*forms)
    return x.where(good).select(*keys, "tag", "unit", F.col("o.end").try_cast("date").alias("event_date"), F.col("o.filed").try_cast("date").alias("pub_date"), F.col("o.val").alias("value"), F.col("o.form").alias("form_type"), F.concat_ws("", F.col("o.fy").cast("string"), "o.fp").alias("period"))


def first_tag(facts: DataFrame, keys: list[str], priority: list[str]) -> DataFrame:
    """Of each key, the rows of the first tag in ``priority`` that it has at all."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("tag"))
    ranked = facts.withColumn("place__", place).where("place__ > 0")
    best = ranked.groupBy(*keys).agg(F.min("place__").alias("place__"))
    return ranked.join(best, [*keys, "place__"], "left_semi").drop("place__")


def statements(raw: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """Fundamentals JSON to (*keys, statement, date, filing_date, currency, items...), one row a quarter and statement."""
    kinds = {"BS": "Balance_Sheet", "CF": "Cash_Flow", "IS": "Income_Statement"}
    body = "struct<quarterly:map<string,map<string,string>>>"
    parsed = raw.select(*keys, F.from_json("payload", f"struct<Financials:map<string,{body}>>")["Financials"].alias("f"))
    out = None
    for kind, name in kinds.items():
        rows = parsed.select(*keys, F.lit(kind).alias("statement"), F.explode(F.element_at("f", name)["quarterly"]).alias("date", "m"))
        text = lambda c: F.nullif(F.nullif(F.element_at("m", c), F.lit("")), F.lit("None"))
        one = rows.select(*keys, "statement", "date", text("filing_date").alias("filing_date"), text("currency_symbol").alias("currency"), *(number(F.element_at("m", c)).alias(c) for c in items))
        out = one if out is None else out.unionByName(one)
    return out


# --- macro series ---------------------------------------------------------------------------------------------------


def observations(raw: DataFrame, keys: list[str]) -> DataFrame:
    """{"observations": [{"date", "value", "realtime_start"}]} to (*keys, event_date, pub_date, value); '.' is missing and dropped."""
    schema = "struct<observations:array<struct<date:string,value:string,realtime_start:string>>>"
    x = raw.select(*keys, F.explode(F.from_json("payload", schema)["observations"]).alias("o"))
    return x.select(*keys, F.col("o.date").try_cast("date").alias("event_date"), F.col("o.realtime_start").try_cast("date").alias("pub_date"), number(F.col("o.value")).alias("value")).where("event_date is not null and value is not null")


def table_rows(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Input-output API JSON to (*keys, source, target, year, flow): {"BEAAPI": {"Results": [{"Data": [...]}]}}."""
    row = "struct<RowCode:string,ColCode:string,Year:string,DataValue:string>"
    schema = f"struct<BEAAPI:struct<Results:array<struct<Data:array<{row}>>>>>"
    x = raw.select(*keys, F.explode(F.flatten(F.transform(F.from_json("payload", schema)["BEAAPI"]["Results"], lambda r: r["Data"]))).alias("d"))
    return x.select(*keys, F.col("d.RowCode").alias("source"), F.col("d.ColCode").alias("target"), F.col("d.Year").try_cast("int").alias("year"), number(F.col("d.DataValue")).alias("flow")).where("flow is not null and year is not null")


def nested_years(raw: DataFrame, keys: list[str]) -> DataFrame:
    """{"values": {indicator: {country: {year: value}}}} to (*keys, indicator, country, year, value)."""
    x = raw.select(*keys, F.explode(F.from_json("payload", "struct<values:map<string,map<string,map<string,double>>>>")["values"]).alias("indicator", "c"))
    x = x.select(*keys, "indicator", F.explode("c").alias("country", "y")).select(*keys, "indicator", "country", F.explode("y").alias("year", "value"))
    return x.withColumn("year", F.col("year").try_cast("int")).where("year is not null and value is not null")


def sdmx_series(raw: DataFrame, keys: list[str], wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """SDMX-JSON to (*keys, dims, period, value): series keys are colon-joined places in the dimensions' value lists.

    ``wanted``: dimension -> allowed values; a dimension that a source lacks lets all pass.
    """
    dim = "struct<id:string,values:array<struct<id:string>>>"
    schema = f"struct<data:struct<structures:array<struct<dimensions:struct<series:array<{dim}>,observation:array<{dim}>>>>,dataSets:array<struct<series:map<string,struct<observations:map<string,array<double>>>>>>>>"
    p = raw.select(*keys, F.from_json("payload", schema)["data"].alias("d"))
    p = p.select(*keys, F.get(F.col("d.structures"), 0)["dimensions"].alias("m"), F.explode(F.get(F.col("d.dataSets"), 0)["series"]).alias("series__", "s"))
    dims = F.map_from_entries(F.zip_with(F.col("m.series"), F.split("series__", ":"), lambda x, i: F.struct(x["id"], F.get(x["values"], i.cast("int"))["id"])))
    p = p.select(*keys, dims.alias("dims"), F.get(F.col("m.observation"), 0)["values"].alias("times"), F.explode("s.observations").alias("at", "v"))
    out = p.select(*keys, "dims", F.get("times", F.col("at").cast("int"))["id"].alias("period"), F.get("v", 0).alias("value")).where("value is not null")
    for name, values in (wanted or {}).items():
        out = out.where(F.element_at("dims", name).isNull() | F.element_at("dims", name).isin(values))
    return out


def sdmx_compact(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Compact SDMX JSON to (*keys, area, indicator, period, value); Series and Obs may be one object or a list."""
    obs, series = "struct<`@TIME_PERIOD`:string,`@OBS_VALUE`:string>", "struct<`@REF_AREA`:string,`@INDICATOR`:string,Obs:string>"
    body = F.get_json_object("payload", "$.CompactData.DataSet.Series")
    many = lambda text, kind: F.when(text.startswith("["), F.from_json(text, f"array<{kind}>")).otherwise(F.array(F.from_json(text, kind)))
    s = raw.withColumn("b", body).where("b is not null").select(*keys, F.explode(many(F.col("b"), series)).alias("s"))
    o = s.where(F.col("s.Obs").isNotNull()).select(*keys, F.col("s.`@REF_AREA`").alias("area"), F.col("s.`@INDICATOR`").alias("indicator"), F.explode(many(F.col("s.Obs"), obs)).alias("o"))
    return o.select(*keys, "area", "indicator", F.col("o.`@TIME_PERIOD`").alias("period"), number(F.col("o.`@OBS_VALUE`")).alias("value")).where("value is not null")


#: A comma that isn't inside quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def sdmx_csv(raw: DataFrame, keys: list[str]) -> DataFrame:
    """SDMX as CSV to (*keys, period, value): columns are found by the names in each payload's own header, in whatever order.

    Payloads without TIME_PERIOD or OBS_VALUE give nothing, rows without a period or a number neither. Quoted values may hold commas and doubled quotes,
    but no line ends.
    """
    plain = lambda v: F.regexp_replace(F.trim(v), r'^"|"$', "")
    lines = F.split(F.regexp_replace("payload", "\r", ""), "\n")
    named = raw.select(*keys, lines.alias("l__"), F.transform(F.split(F.get(lines, 0), _COMMA), plain).alias("h__"))
    placed = named.select(*keys, "l__", F.array_position("h__", "TIME_PERIOD").alias("t__"), F.array_position("h__", "OBS_VALUE").alias("v__")).where("t__ > 0 AND v__ > 0")
    rows = placed.select(*keys, "t__", "v__", F.explode(F.slice("l__", 2, F.greatest(F.size("l__") - 1, F.lit(0)))).alias("line__"))
    cut = rows.withColumn("c__", F.split("line__", _COMMA))
    out = cut.select(*keys, plain(F.get("c__", F.col("t__").cast("int") - 1)).alias("period"), plain(F.get("c__", F.col("v__").cast("int") - 1)).try_cast("double").alias("value"))
    return out.where("period <> '' AND value IS NOT NULL AND NOT isnan(value)")


# --- news, prices, lists -----------------------------------------------------------------------------------------------


def first_tone(text: Column) -> Column:
    """The first of comma-joined numbers, or null."""
    return F.get(F.split(text, ","), 0).try_cast("double")


def names_and_themes(text: Column) -> Column:
    """'A,12;B,3;' to the distinct lower-case names before the commas."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.lower(F.trim(F.get(F.split(x, ","), 0)))), lambda x: x != ""))


def knowledge_graph(lines: DataFrame, columns: dict[str, int] | None = None) -> DataFrame:
    """Tab-separated news lines (column ``value``) to (doc_id, themes, orgs, tone); lines with too few fields are dropped, repeated ids kept once."""
    at = columns or {"doc_id": 4, "themes": 8, "orgs": 14, "tone": 15}
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) > max(at.values())).select(F.get(f, at["doc_id"]).alias("doc_id"), names_and_themes(F.get(f, at["themes"])).alias("themes"), names_and_themes(F.get(f, at["orgs"])).alias("orgs"), first_tone(F.get(f, at["tone"])).alias("tone"))
    return rows.where("doc_id <> ''").dropDuplicates(["doc_id"])


def long_prices(wide: DataFrame, date: str = "date") -> DataFrame:
    """One column a ticker to (date, ticker, close), nulls dropped."""
    tickers = [c for c in wide.columns if c != date]
    return wide.unpivot(date, tickers, "ticker", "close").where("close is not null")


def renamed_by_synonym(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Columns found under any of their names; ValueError for one that isn't there under any."""
    have = {c.strip().lower(): c for c in df.columns}
    found = {name: next((have[s.lower()] for s in [name, *words] if s.lower() in have), None) for name, words in synonyms.items()}
    missing = [n for n, c in found.items() if c is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


def after_header(lines: DataFrame, marker: str = "Ticker", order: str = "line", text: str = "value") -> DataFrame:
    """The lines from the first that contains ``marker`` on: (line, value). ``order`` numbers the lines of one small file."""
    start = lines.where(F.col(text).contains(marker)).agg(F.min(order).alias("start__"))
    return lines.crossJoin(F.broadcast(start)).where(F.col(order) >= F.col("start__")).drop("start__")


def day_first(lines: DataFrame, date: str, value: str, pattern: str = "dd MMM yyyy") -> DataFrame:
    """(event_date, value) with dates in ``pattern``; what doesn't parse is dropped."""
    return lines.select(F.try_to_timestamp(F.col(date), F.lit(pattern)).cast("date").alias("event_date"), number(F.col(value)).alias("value")).where("event_date is not null and value is not null")


def not_stored(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``wanted`` a resumed load still has to get."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")


def nearest_slot(slots: DataFrame, day: str, minute: str, target: int = 12 * 60) -> DataFrame:
    """Of each day, the slot nearest to ``target`` minutes (ties: the earlier)."""
    best = slots.groupBy(day).agg(F.min(F.struct(F.abs(F.col(minute) - target).alias("far"), F.col(minute).alias("m"))).alias("b"))
    return slots.join(best.select(day, F.col("b.m").alias(minute)), [day, minute], "left_semi")

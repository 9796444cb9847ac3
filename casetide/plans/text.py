"""Queries of free text. Orders pick sentences from a list; the SQL side holds the answers worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..operators import known_objects
from .registry import query, table

SENTENCES = [
    "We saw 3 lights for 2-3 minutes heading north.",
    "My wife and I watched a bright orange fireball for 10 seconds.",
    "It was not a plane; no sound at all, hovering for half an hour",
    "Two police officers reported a silver disk, grey and Silver.",
    "several people saw a line of white lights for an hour",
    "three of us were driving at 9:30 p.m. EST",
    None,
    "",
    "Seen by 2 witnesses at 2130, lasted 1/2 hour, then 45 sec",
    "unlike any aircraft. A jet flew over toward the southeast",
]
#: Per sentence: seconds, witnesses, colours, heading, aircraft, silent, hover, police, line, hour, minute, zone.
_ANSWERS = [
    (146.969385, 2, "", "north", 0, 0, 0, 0, 0, None, None, None),
    (10, 2, "orange", "", 0, 0, 0, 0, 0, None, None, None),
    (1800, None, "", "", 0, 1, 0, 0, 0, None, None, None),
    (None, None, "gray,silver", "", 0, 0, 0, 1, 0, None, None, None),
    (3600, 5, "white", "", 0, 0, 0, 0, 1, None, None, None),
    (None, 3, "", "", 0, 0, 0, 0, 0, 21, 30, -5),
    (None, None, "", "", 0, 0, 0, 0, 0, None, None, None),
    (None, None, "", "", 0, 0, 0, 0, 0, None, None, None),
    (1800, 3, "", "", 0, 0, 0, 0, 0, 21, 30, None),
    (None, None, "", "southeast", 1, 0, 0, 0, 0, None, None, None),
]


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _answers(rows: list[tuple], names: str) -> str:
    values = ", ".join("(" + ", ".join(map(_value, (i, *r))) + ")" for i, r in enumerate(rows))
    return f"SELECT o_orderkey, a.* EXCLUDE (k) FROM orders JOIN (VALUES {values}) a(k, {names}) ON k = o_orderkey % {len(rows)}"


def _picked(spark: SparkSession, folder: str, texts: list[str | None]) -> DataFrame:
    text = F.get(F.array(*[F.lit(t).cast("string") for t in texts]), (F.col("o_orderkey") % len(texts)).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", text.alias("text"))


@query(
    "SELECT o_orderkey, seconds::DOUBLE AS seconds, witnesses::DOUBLE AS witnesses, colours, heading, aircraft::BOOLEAN AS aircraft, silent::BOOLEAN AS silent, hover::BOOLEAN AS hover, police::BOOLEAN AS police, line::BOOLEAN AS line, hour::INT AS hour, minute::INT AS minute, zone::INT AS zone FROM ("
    + _answers(_ANSWERS, "seconds, witnesses, colours, heading, aircraft, silent, hover, police, line, hour, minute, zone") + ")"
)
def narrative_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Duration, witnesses, colours, heading, flags with negation, clock (TXT-01 to TXT-08, TXT-12)."""
    t = F.col("text")
    d, clock = T.description_flags(t), T.clock(t)
    return _picked(spark, folder, SENTENCES).select(
        "o_orderkey", F.round(T.duration_s(t), 6).alias("seconds"), T.witness_count(t).alias("witnesses"), T.colours(t).alias("colours"), T.heading(t).alias("heading"), d["d_aircraft_word_txt"].alias("aircraft"), d["d_silent_txt"].alias("silent"),
        d["d_hover_txt"].alias("hover"), T.observer_flags(t)["obs_police_txt"].alias("police"), d["d_line_formation_txt"].alias("line"), clock["hour"].alias("hour"), clock["minute"].alias("minute"), clock["utc_hours"].alias("zone"),
    )


FRENCH = ["Vers 22h, pendant 10 minutes, deux témoins", "à 21h30 une lumière, avec ma femme, durée d'environ 1,5 heure", "pas un avion, un BALLON", None, "Le témoin voit un éclair puis un avion à réaction"]


@query("SELECT o_orderkey, hour::INT AS hour, minute::INT AS minute, approximate::BOOLEAN AS approximate, seconds::DOUBLE AS seconds, witnesses::DOUBLE AS witnesses, aircraft::BOOLEAN AS aircraft, balloon::BOOLEAN AS balloon, lightning::BOOLEAN AS lightning FROM ("
       + _answers([(22, 0, 1, 600, 2, 0, 0, 0), (21, 30, 0, 5400, 2, 0, 0, 0), (None, None, None, None, None, 0, 0, 0), (None, None, None, None, None, 0, 0, 0), (None, None, None, None, 1, 1, 0, 1)], "hour, minute, approximate, seconds, witnesses, aircraft, balloon, lightning") + ")")
def narrative_facts_fr(spark: SparkSession, folder: str) -> DataFrame:
    """The same facts from French text; a negator within 30 characters denies (TXT-10, TXT-11)."""
    t = F.col("text")
    d, clock = T.description_flags_fr(t), T.clock_fr(t)
    return _picked(spark, folder, FRENCH).select(
        "o_orderkey", clock["hour"].alias("hour"), clock["minute"].alias("minute"), clock["approximate"].alias("approximate"), T.duration_fr_s(t).alias("seconds"), T.witness_count_fr(t).alias("witnesses"),
        d["d_aircraft_word_txt"].alias("aircraft"), d["d_balloon_word_txt"].alias("balloon"), d["d_lightning_word_txt"].alias("lightning"),
    )


NAMES = ["Light", " orb ", "boomerang", None, "disc", "3/14/1999", "13/40/2001", "2001 Mar  4 0512:30", "1999 Dec 31", "half"]


@query("SELECT o_orderkey, shape, year::INT AS year, month::INT AS month, day::INT AS day, launched, has_clock::BOOLEAN AS has_clock, amount::DOUBLE AS amount FROM ("
       + _answers([("light", None, None, None, None, None, None), ("sphere", None, None, None, None, None, None), ("other", None, None, None, None, None, None), ("unknown", None, None, None, None, None, None), ("disk", None, None, None, None, None, None),
                   ("other", 1999, 3, 14, None, None, None), ("other", 2001, None, None, None, None, None), ("other", None, None, None, "2001-03-04 05:12:30", 1, None), ("other", None, None, None, "1999-12-31 12:00:00", 0, None), ("other", None, None, None, None, None, 0.5)],
                  "shape, year, month, day, launched, has_clock, amount") + ")")
def structured_text(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes, dates, launch times and number words (TXT-02, TXT-09, TXT-13, TXT-14)."""
    t = F.col("text")
    date, launch = T.month_day_year(t), T.launch_time(t)
    return _picked(spark, folder, NAMES).select(
        "o_orderkey", T.shape(t).alias("shape"), date["year"].alias("year"), date["month"].alias("month"), date["day"].alias("day"),
        F.date_format(launch["time"], "yyyy-MM-dd HH:mm:ss").alias("launched"), launch["has_clock"].alias("has_clock"), T.number(t).alias("amount"),
    )


PLACES = [("St. Johns", "Saint John's"), ("Mount Vernon", "Mt Vernon"), ("abcd", "abed"), ("north bay", "bay north"), (None, "x")]


@query("SELECT o_orderkey, left_name, ratio::DOUBLE AS ratio, sorted_ratio::DOUBLE AS sorted_ratio FROM ("
       + _answers([("saint johns", 95.652174, 95.652174), ("mount vernon", 100, 100), ("abcd", 75, 75), ("north bay", 55.555556, 100), (None, 0, 0)], "left_name, ratio, sorted_ratio") + ")")
def fuzzy_names(spark: SparkSession, folder: str) -> DataFrame:
    """Plain names and similarity of names, as they stand and word by word (TXT-16, TXT-19, JON-25)."""
    pick = lambda i: F.get(F.array(*[F.lit(p[i]).cast("string") for p in PLACES]), (F.col("o_orderkey") % len(PLACES)).cast("int"))
    named = table(spark, folder, "orders").select("o_orderkey", T.ascii_name(pick(0)).alias("left_name"), T.ascii_name(pick(1)).alias("right_name"))
    return named.select("o_orderkey", "left_name", F.round(fuzzy.ratio(F.col("left_name"), F.col("right_name")), 6).alias("ratio"), F.round(fuzzy.sorted_ratio(F.col("left_name"), F.col("right_name")), 6).alias("sorted_ratio"))


@query(r"""
SELECT doc_id, regexp_matches(text, '(?i)licensed under|released under') AS licence, regexp_matches(text, '[!?]') AS marks, len(string_split(text, chr(10)))::INT AS n_lines, list_contains(string_split(coalesce(source, ''), '1'), 'src') AS one,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), 'apache|mit license|gnu general|cc by'))), ',') AS names FROM documents
""")
def text_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags, splits and sorted distinct matches over documents (FLT-04, TXT-04, TXT-07, TXT-20, ARR-01)."""
    t = F.col("text")
    names = F.regexp_extract_all(F.lower(t), F.lit("(apache|mit license|gnu general|cc by)"), 1)
    return table(spark, folder, "documents").select(
        "doc_id", T.has(t, "licensed under|released under").alias("licence"), T.has(t, "[!?]").alias("marks"), F.size(F.split(t, "\n")).alias("n_lines"), T.member(F.col("source"), "src", "1").alias("one"), F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("names"),
    )


@query("""
SELECT conv_id, count(*) AS n_turns, array_to_string(list(role ORDER BY turn), '>') AS roles, min_by(length(text), turn)::INT AS first_length FROM conversations GROUP BY 1
""")
def ordered_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation in order, delimited (ARR-06, AGG-05)."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("roles"), F.min_by(F.length("text"), "turn").alias("first_length")
    )


@query(None)
def known_object_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Chances of known explanations from sentence, time and place of each picked report (DOM-02, DOM-03)."""
    t = F.col("text")
    rows = _picked(spark, folder, SENTENCES).withColumns(T.description_flags(t)).withColumn("duration_s", T.duration_s(t))
    given = {c: F.col(c) for c in rows.columns} | {"sun_alt": F.col("o_orderkey") % 60 - 40.0, "n_launch_lpost3h_1500km": F.col("o_orderkey") % 3, "venus_alt": F.lit(10.0), "venus_elong": F.lit(30.0), "year": F.lit(2015), "mmdd": F.lit("07-04")}
    scored = known_objects.scored(rows, given)
    names = [c for c in scored.columns if c.startswith("p_")]
    return scored.select("o_orderkey", *[F.round(c, 6).alias(c) for c in names], "top_explanation")

"""Chronologies and the reports that are shared of them.

Events are rows (chronology, ord, timestamp, category, source_file, speaker,
event_details). A chronology is one case's timeline, of any length: events are
numbered by ranges (`order.ranked`), and a report is rows (chronology, number, text)
whose texts, in order, are the report. Number 0 is its head. Where cases are small,
`whole` gives each report as one string.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BANNER_MARK, RULE, parsed_time, with_default
from .order import ranked

EVENT_COLUMNS = ("chronology", "ord", "timestamp", "category", "source_file", "speaker", "event_details")

#: The notice above everything that leaves the house; its mark and rules are what re-identification looks for.
BANNER = "\n".join(
    [
        RULE,
        f"{BANNER_MARK}: KEEP THE CODES",
        RULE,
        "Names of people, organisations and places in this text are replaced by codes,",
        "each a kind and eight hexadecimal digits.",
        "",
        "Leave every code exactly as it stands, also in texts that you write from this",
        "one. Do not guess, shorten, translate or remove a code.",
        "",
        "The sender holds the only list of what the codes stand for. With the codes",
        "unchanged, the sender can put the names back into what you return.",
        RULE,
        "",
        "",
    ]
)


def unify(transcripts: Iterable[DataFrame]) -> DataFrame:
    """All transcripts' events in one frame, with ts where the timestamp parses. Raw timestamps stay."""
    all_ = reduce(DataFrame.unionByName, (t.select(*EVENT_COLUMNS) for t in transcripts))
    return all_.withColumn("ts", parsed_time(F.col("timestamp")))


def placed(events: DataFrame) -> DataFrame:
    """The events with placed_ts and what else strict interleaving needs.

    An event without a time stands at the last time known before it in its source,
    after the events of that time and by the number of its page, line or turn; one
    before any known time stands at its source's first, ahead of it. Sources without any
    time have none here either. Sources may have any length.
    """
    source = F.concat_ws("\0", F.coalesce(F.col("chronology").cast("string"), F.lit("\1")), F.coalesce("source_file", F.lit("\1")))
    followed = ranked(events.withColumn("_source", source), "_source", ["ord", "event_details"], into="_place", carried=("ts", "_known"), purpose="placed")
    first = followed.where("ts is not null").groupBy("_source").agg(F.min_by("ts", "_place").alias("_first"))
    page = F.regexp_extract("timestamp", r"(?i)\b(?:page|line|turn)\s+([0-9]{1,9})", 1)
    stage = F.when(F.col("ts").isNotNull(), 1).when(F.col("_known").isNotNull(), 2).otherwise(0)
    return followed.join(first, "_source", "left").withColumns(
        {"placed_ts": F.coalesce("ts", "_known", "_first"), "stage": stage, "page": F.when(F.col("ts").isNull() & (page != ""), page.cast("long"))}
    ).drop("_source", "_place", "_known", "_first")


def event_order(events: DataFrame) -> list[Column]:
    """By time, events without one last, then by source and place in it; placed events by their placed time."""
    if "placed_ts" in events.columns:
        return [F.col("placed_ts").asc_nulls_last(), F.col("source_file"), F.col("stage"), F.col("page").asc_nulls_last(), F.col("ord"), F.col("event_details")]
    return [F.col("ts").asc_nulls_last(), F.col("source_file"), F.col("ord"), F.col("event_details")]


def numbered(events: DataFrame) -> DataFrame:
    """With number, from 1 in each chronology, in the order of event_order."""
    return ranked(events, "chronology", event_order(events), into="number", purpose="events").withColumn("number", F.col("number") + 1)


def categories(events: DataFrame) -> DataFrame:
    """(chronology, categories_found): distinct, in text order."""
    return events.where("category is not null").groupBy("chronology").agg(F.array_sort(F.collect_set("category")).alias("categories_found"))


def _shown(name: str) -> Column:
    return with_default(name, F.col(name))


def whole(lines: DataFrame) -> DataFrame:
    """(chronology, report): the texts of each report as one string, for cases that a row can hold."""
    rows = lines.groupBy("chronology").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("rows"))
    return rows.select("chronology", F.array_join(F.transform("rows", lambda x: x["text"]), "").alias("report"))


def _rows(heads: DataFrame, head: Column, events: DataFrame | None = None, block: Column | None = None) -> DataFrame:
    """Heads as number 0, then the events' blocks. Events of chronologies without a head are left out."""
    first = heads.select("chronology", F.lit(0).cast("long").alias("number"), head.alias("text"))
    if events is None:
        return first
    return first.union(numbered(events.join(heads.select("chronology"), "chronology", "left_semi")).select("chronology", "number", block.alias("text")))


def _sections(*parts: Column) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


# The headings and labels of the three reports and of the legend below, which readers and re-identification know them by.


def transcription(headers: DataFrame, events: DataFrame) -> DataFrame:
    """(chronology, number, text): the plain-text transcription. headers: (chronology, patient_summary, categories_found)."""
    blank = F.when(F.col("number") > 1, "\n").otherwise("")
    block = F.concat(blank, F.lit("["), F.col("number"), F.lit("] "), _shown("timestamp"), F.lit("  |  Speaker: "), _shown("speaker"), F.lit("  |  Category: "), _shown("category"), F.lit("\n"), _shown("event_details"), F.lit("\n"))
    thick, thin = "=" * 72, "-" * 72
    summary = F.when(F.col("patient_summary") != "", F.concat(F.lit("PATIENT SUMMARY:\n"), "patient_summary", F.lit("\n\n")))
    kinds = F.when(F.size("categories_found") > 0, F.concat(F.lit("CATEGORIES: "), F.array_join("categories_found", ", "), F.lit("\n\n")))
    head = _sections(F.lit(f"{thick}\nDE-IDENTIFIED TRANSCRIPTION\n{thick}\n\n"), summary, kinds, F.lit(f"{thin}\nCHRONOLOGICAL EVENTS\n{thin}\n\n"))
    return _rows(headers, head, events, block)


def timeline_report(headers: DataFrame, events: DataFrame) -> DataFrame:
    """(chronology, number, text): banner, summary and a block for each event."""
    field = lambda title, name: F.concat(F.lit(title), F.coalesce(F.col(name), F.lit("None")), F.lit("\n"))
    block = F.concat(F.lit("Event #"), F.col("number"), F.lit("\n"), field("Timestamp: ", "timestamp"), field("Category:  ", "category"), field("Speaker:   ", "speaker"), field("Details:   ", "event_details"), F.lit("-" * 80 + "\n\n"))
    head = F.concat(F.lit(BANNER + "PATIENT SYNTHESIS SUMMARY:\n"), F.coalesce("patient_summary", F.lit("")), F.lit(f"\n\n{RULE}\nUNIFIED CLINICAL TIMELINE (PSEUDONYMISED)\n{RULE}\n\n"))
    return _rows(headers, head, events, block)


def legend_lines(legend: DataFrame) -> DataFrame:
    """(number, text): the codes with their types and contexts, in order, between title and end. Give it a legend made safe by the audit module."""
    line = F.concat(F.lit("  "), F.col("pseudonym"), F.lit("  ["), F.coalesce("entity_type", F.lit("UNKNOWN")), F.lit("]  "), F.coalesce("relationship_context", F.lit("")), F.lit("\n"))
    placed = ranked(legend.select("ord", "pseudonym", line.alias("text"), F.lit("").alias("grp")), "grp", ["ord", "pseudonym"], into="number", purpose="legend")
    ends = legend.sparkSession.createDataFrame([(1, f"{RULE}\nPSEUDONYM HASH LEGEND\n{RULE}\n\n"), (2**62, "\n")], "number long, text string")
    return placed.select((F.col("number") + 2).alias("number"), "text").union(ends)


def synthesis_summary(headers: DataFrame, legend: DataFrame | None = None) -> DataFrame:
    """(chronology, number, text): banner, summary, categories and, where one is given, the legend, as legend_lines makes it, under each."""
    kinds = F.when(F.size("categories_found") > 0, F.concat(F.lit("IDENTIFIED CATEGORIES:\n"), F.array_join(F.transform("categories_found", lambda c: F.concat(F.lit("- "), c, F.lit("\n"))), ""), F.lit("\n")))
    head = F.concat(F.lit(BANNER + "PATIENT SYNTHESIS SUMMARY:\n"), F.coalesce("patient_summary", F.lit("")), F.lit("\n\n"))
    rows = _rows(headers, _sections(head, kinds))
    if legend is None:
        return rows
    # Every report has the whole legend: what is made is what is written, and neither side is sent whole to a task.
    return rows.union(headers.select("chronology").crossJoin(legend).select("chronology", "number", "text"))

"""Whole runs: from a folder of inputs to what may be shared, and back.

Two folders are written: `secure` holds what names people (the inputs' contents,
transcripts, the chronology, the catalogue, the map, the salt), `output` only what may leave the
house. They must differ. Every table is Parquet; writing over an earlier run is
an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import deidentified_name, extension, reidentified_name
from ..operators import audit, chronology
from ..operators.catalogue import ENTITIES, MapTooLarge, identity_catalogue, replacement_map, with_pseudonym
from ..operators.discovery import Cataloguer, Discoverer, Extractor, StrictCataloguer, TextExtractor
from ..operators.docx import docx_rewritten, docx_text
from ..operators.pages import editor_for
from ..operators.reidentify import reidentify_json, reidentify_texts
from ..operators.replace import apply_map
from ..sources import files


class LeakFound(RuntimeError):
    """A name is still in what was to be shared; nothing was shared."""


@dataclass(frozen=True)
class Run:
    """What a run has made. Reports are rows (chronology, number, text)."""

    events: DataFrame
    catalogue: DataFrame
    edited: DataFrame
    transcriptions: DataFrame
    summaries: DataFrame
    #: (path, reason) of inputs that could not be read.
    unread: DataFrame


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def deidentify(spark: SparkSession, inputs: str, secure: str, output: str, discoverer: Discoverer, extractor: Extractor | None = None, cataloguer: Cataloguer | None = None, summary: str = "", case: str = "case", allow_leaks: bool = False) -> Run:
    """Transcripts, one chronology, entities, pseudonyms, edited documents and reports.

    Nothing is written to output before the audit has found every key of the
    map gone from the chronology's columns, the summary, the legend and the
    edited documents (keys that stand in pseudonyms are expected and no leaks).
    """
    if secure.rstrip("/") == output.rstrip("/"):
        raise ValueError("secure and output must be two folders")
    # Many small files are opened once.
    contents = _saved(files.read_contents(spark, inputs), f"{secure}/inputs")
    unread = _saved(contents.where("reason is not null").select("path", "reason"), f"{secure}/unread_inputs")
    texts = contents.where("route = 'text' and reason is null").select("path", F.decode("content", "utf-8").alias("text"))
    documents = docx_text(contents.where("route = 'docx' and reason is null").select("path", "content")).select("path", "text")
    transcripts = (extractor or TextExtractor()).extract(texts.unionByName(documents).withColumn("chronology", F.lit(case)))
    transcripts = _saved(transcripts, f"{secure}/transcripts")
    events = _saved((cataloguer or StrictCataloguer()).catalogue([transcripts]), f"{secure}/unified_chronology")

    entities = _saved(discoverer.discover(events, "event_details").select(*ENTITIES.names), f"{secure}/discovered_entities")
    named = with_pseudonym(entities, files.salt(spark, secure))
    catalogue = _saved(identity_catalogue(named), f"{secure}/identity_catalogue")
    mapping = _saved(replacement_map(named), f"{secure}/replacement_map")
    done = _saved(apply_map(events, mapping, ["timestamp", "category", "source_file", "speaker", "event_details"]), f"{secure}/deidentified_chronology")

    heads = spark.createDataFrame([(case, summary)], "chronology string, patient_summary string")
    heads = apply_map(heads, mapping, ["patient_summary"]).join(chronology.categories(done), "chronology", "left")
    legend = audit.safe_legend(catalogue, mapping)
    editable = contents.where((editor_for(extension(F.col("path"))) == "docx") & F.col("reason").isNull()).select("path", "content")
    edited = _saved(docx_rewritten(editable, mapping).withColumn("name", deidentified_name(F.col("path"))), f"{secure}/edited_documents")
    if not allow_leaks:
        # All that would leave the house, documents included.
        texts = [done.select(F.explode(F.array("timestamp", "category", "source_file", "speaker", "event_details")).alias("text")), heads.select(F.col("patient_summary").alias("text")), legend.select(F.concat_ws(" ", "entity_type", "relationship_context").alias("text")), docx_text(edited).select("text")]
        found = audit.shared_leaks(reduce(DataFrame.union, texts), "text", mapping, catalogue)
        if not found.isEmpty():
            raise LeakFound(f"{found.count()} keys are left")

    files.write_contents(edited, f"{output}/documents")
    reports = {
        "deidentified_transcription.txt": chronology.transcription(heads, done),
        "synthesis_summary.txt": chronology.synthesis_summary(heads, chronology.legend_lines(legend)),
        "shareable_pseudonymised_report.txt": chronology.timeline_report(heads, done),
    }
    for name, report in reports.items():
        files.write_report(report, f"{output}/{name}")
    files.write_json(done, f"{output}/shareable_pseudonymised_report.json")
    return Run(done, catalogue, edited, reports["deidentified_transcription.txt"], reports["synthesis_summary.txt"], unread)


def reidentify(spark: SparkSession, returned: str, secure: str, output: str) -> DataFrame:
    """(path, text) of returned texts with the names back, written to output under their names, JSON as JSON; DOCX files as rows (path, content).

    A file whose editor is missing here (PDF) or that can't be read is an error, not a copy.
    """
    catalogue = spark.read.parquet(f"{secure}/identity_catalogue")
    contents = files.read_contents(spark, returned)
    missing = contents.where("route not in ('text', 'docx') or reason is not null").select("path", "reason").limit(1).collect()
    if missing:
        raise files.Unsupported(f"{missing[0].path}: {missing[0].reason or 'its kind needs a plug-in'}")
    texts = contents.where("route = 'text'").select("path", F.decode("content", "utf-8").alias("text"))
    plain = reidentify_texts(texts.where(extension(F.col("path")) != ".json"), "text", catalogue, anywhere=True)
    done = plain.unionByName(reidentify_json(texts.where(extension(F.col("path")) == ".json"), "text", catalogue))
    done.write.parquet(f"{output}/reidentified_texts")
    done = spark.read.parquet(f"{output}/reidentified_texts")
    files.write_texts(done.withColumn("name", reidentified_name(F.col("path"))), f"{output}/reidentified_files")
    back = catalogue.select(F.col("pseudonym").alias("k"), F.col("canonical_name").alias("v"), "ord", F.lit(0).alias("place"))
    files.write_contents(docx_rewritten(contents.where("route = 'docx'").select("path", "content"), back), f"{output}/reidentified_documents")
    return done


__all__ = ["LeakFound", "MapTooLarge", "Run", "deidentify", "reidentify"]

"""python -m maskwright deidentify|reidentify: whole runs from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.catalogue import ENTITIES
from .operators.discovery import PATTERNS, RegexGazetteer, SuppliedEntities
from .plans import pipeline
from .sources.files import read_json


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    forth = commands.add_parser("deidentify", help="inputs to pseudonymised documents and reports")
    forth.add_argument("--input", required=True)
    forth.add_argument("--entities", help="JSON of entities; without it, patterns are looked for")
    forth.add_argument("--summary", default="")
    back = commands.add_parser("reidentify", help="returned texts and documents to ones with names")
    back.add_argument("--input", required=True)
    for command in (forth, back):
        command.add_argument("--secure", required=True)
        command.add_argument("--output", required=True)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    if args.command == "reidentify":
        pipeline.reidentify(spark, args.input, args.secure, args.output)
        return
    discoverer = SuppliedEntities(read_json(spark, args.entities, ENTITIES)) if args.entities else RegexGazetteer(PATTERNS)
    pipeline.deidentify(spark, args.input, args.secure, args.output, discoverer, summary=args.summary)


if __name__ == "__main__":
    main()

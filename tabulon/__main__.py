"""Command line: ``python -m tabulon --templates FOLDER [--format json] [--out PATH] FILES``."""

from __future__ import annotations

import argparse
import re
import sys


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    from tabulon.sources.readers import READERS

    parser = argparse.ArgumentParser(prog="tabulon", description="Extracts records from documents by templates.")
    parser.add_argument("files", help="a file or folder of documents, as Spark reads paths")
    source = parser.add_argument_group("templates")
    source.add_argument("--templates", help="folder of YAML or JSON templates")
    source.add_argument("--built-in", action="store_true", help="add the general templates after these; alone where no folder is given")
    source.add_argument("--template-name", help="only templates whose name contains this")
    reading = parser.add_argument_group("reading")
    reading.add_argument("--reader", choices=list(READERS), help="read all documents with this one")
    reading.add_argument("--engine", choices=("auto", "native", "python"), default="auto", help="for texts: what runs the patterns")
    reading.add_argument("--ai", action="store_true", help="ask the configured model for what no template takes, or for the draft")
    writing = parser.add_argument_group("writing")
    writing.add_argument("--format", choices=("json", "csv", "xml"), default="json")
    writing.add_argument("--date-format", default="%Y-%m-%d")
    writing.add_argument("--out", default="-", help="folder to write to; - prints JSON lines")
    writing.add_argument("--errors", action="store_true", help="give documents without a record, with the reason")
    writing.add_argument("--explain", action="store_true", help="print each field of each record, and what is missing")
    writing.add_argument("--copy", metavar="FOLDER", help="copy documents to a folder, named by their records")
    writing.add_argument("--move", metavar="FOLDER", help="move them there")
    writing.add_argument("--file-name", default="{date} {invoice_number} {desc}", help="that name; the suffix stays")
    writing.add_argument("--draft", action="store_true", help="print a template drafted from the first document and what it finds")
    writing.add_argument("--review", action="store_true", help="with --draft: ask about each field")
    parser.add_argument("--debug", action="store_true")
    parser.add_argument("--json-log", action="store_true", help="log lines as JSON")
    parser.add_argument("--no-colour", action="store_true")
    return parser.parse_args(given)


def _draft(spark, options: argparse.Namespace) -> int:
    import json

    from tabulon import ai
    from tabulon.operators import authoring
    from tabulon.sources import readers

    file = readers.read_folder(spark, options.files).orderBy("path").limit(1)
    first = file.first()
    if first is None:
        print("no document", file=sys.stderr)
        return 1
    for name in readers.resolve(first.path, options.reader):
        text = readers.reader_texts(file, [name]).first().text
        if text.strip():
            break
    else:
        print(f"no text in {first.path}", file=sys.stderr)
        return 1
    made = ai.draft_template(text) if options.ai else authoring.draft_template(text)
    if options.review:
        made = authoring.review(made, text)
    print(json.dumps({"template": made, "finds": authoring.preview(text, made)}, ensure_ascii=False, indent=1))
    if options.out != "-":
        with open(options.out, "w", encoding="utf-8") as out:
            json.dump(made, out, ensure_ascii=False, indent=1)
    return 0


def main(given: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tabulon import ai, logs
    from tabulon.plans.contract import ship
    from tabulon.plans.documents import read_documents
    from tabulon.plans.engine import extract
    from tabulon.sinks import files, flat
    from tabulon.sources.readers import read_texts
    from tabulon.sources.templates import named, read_templates, with_built_in

    options = arguments(given)
    logs.configure(options.debug, options.json_log, not options.no_colour)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if options.draft:
        return _draft(spark, options)
    templates = read_templates(options.templates) if options.templates else []
    if options.built_in or not options.templates:
        templates = with_built_in(templates)
    if options.template_name:
        templates = named(templates, options.template_name)
    if options.reader == "text":
        found = extract(read_texts(spark, options.files), templates, engine=options.engine)
    else:
        found = read_documents(spark, options.files, templates, options.reader, provider=ai.get_provider() if options.ai else None)
    if options.errors:
        out = found.where("error is not null").select("doc_id", "template_name", "error", "missing", "unknown")
    else:
        out = found.where("record is not null").select("doc_id", "template_name", F.to_json("record").alias("record"))
    if options.copy or options.move:
        fields = sorted(set(re.findall(r"{(\w+)}", options.file_name)))
        flat_row = found.where("record is not null").select("doc_id", *[F.try_variant_get("record", f"$.{f}", "string").alias(f) for f in fields])
        flat_row = flat_row.withColumns({f: F.regexp_replace(f, r"[ T]00:00:00(?:\.0+)?$", "") for f in fields})
        named_row = flat_row.select(F.col("doc_id").alias("path"), F.concat(files.file_name(flat_row, options.file_name), F.regexp_extract("doc_id", r"\.[^./]*$", 0)).alias("target_name"))
        files.place((row.asDict() for row in named_row.toLocalIterator()), options.copy or options.move, move=bool(options.move))
    if options.explain:
        for row in found.select("doc_id", "template_name", "error", "missing", F.from_json(F.to_json("record"), "map<string,string>").alias("fields")).toLocalIterator():
            print(f"{row.doc_id}: {row.template_name or 'no template'}" + (f", {row.error}" if row.error else ""))
            for name, value in (row.fields or {}).items():
                print(f"  {name}: {value}")
            for name in row.missing or ():
                print(f"  {name} is missing")
    elif options.out == "-":
        for row in out.toJSON().toLocalIterator():
            print(row)
    if options.out != "-":
        {"json": lambda: flat.write_json(out, options.out, options.date_format), "csv": lambda: flat.write_csv(out, options.out, options.date_format), "xml": lambda: flat.write_xml(out, options.out)}[options.format]()
    return 0


if __name__ == "__main__":
    sys.exit(main())

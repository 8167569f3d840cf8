"""A command line over ledgers in a folder: every command prints one JSON object and ends with 0, 1 (an error) or 2 (a check failed).

    python -m folium import FILES LEDGER      fragments and issues of all files of a folder that the ledger lacks
    python -m folium check LEDGER             whether blocks partition atoms and issues are open
    python -m folium outline LEDGER           headings
    python -m folium search LEDGER WORDS      blocks that hold some words
    python -m folium candidates LINES OUT     structure candidates of lines with boxes, with --preview FOLDER as Markdown too

LEDGER, LINES and OUT are folders of Parquet. --limit bounds how many rows a command prints; what it counts or writes is whole.
"""

from __future__ import annotations

import argparse
import json
import os
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import layout, ledger, views
from folium.sources import files

LIMIT = 100


def as_json(payload: dict, pretty: bool) -> str:
    return json.dumps(payload, ensure_ascii=False, **({"indent": 2} if pretty else {"separators": (",", ":")}))


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return os.path.realpath(os.path.expanduser(parts.path)) if parts.scheme in ("", "file") else None


def same_or_inside(path: str, root: str) -> bool:
    """Whether a path is a folder or lies in it, whatever links or letters of other case lead there."""
    here, there = _local(path), _local(root)
    if here is None or there is None:
        return (path.rstrip("/") + "/").startswith(root.rstrip("/") + "/")
    while True:
        if here == there or (os.path.exists(here) and os.path.exists(there) and os.path.samefile(here, there)):
            return True
        if os.path.dirname(here) == here:
            return False
        here = os.path.dirname(here)


def _guard(out: str, *sources: str) -> None:
    for source in sources:
        if same_or_inside(out, source) or same_or_inside(source, out):
            raise ValueError(f"{out} must not be {source}, hold it or lie in it")


def _rows(df: DataFrame, limit: int) -> list[dict]:
    return [json.loads(row[0]) for row in df.limit(limit).select(F.to_json(F.struct(*df.columns))).collect()]


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _import(spark: SparkSession, args: argparse.Namespace) -> dict:
    _guard(args.ledger, args.files)
    try:
        known = _read(spark, args.ledger)
        known = known.select("doc_id").distinct() if known.columns else None
    except Exception as error:  # there is no ledger yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    files.import_files(spark, args.files, known).write.mode("append").parquet(args.ledger)
    now = _read(spark, args.ledger).groupBy().agg(F.count_distinct("doc_id").alias("documents"), F.count("atom_id").alias("blocks"), F.count("issue_id").alias("issues"))
    return now.first().asDict()


def _check(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows = _read(spark, args.ledger)
    held = files.fragments_of(rows)
    split = ledger.partition_check(held.select("doc_id", "atom_id"), held.select("doc_id", F.array("atom_id").alias("source_ids")))
    wrong = split.where("not ok").select("doc_id", F.lit("Source ledger is not an exact partition").alias("error"))
    issues = files.issues_of(rows).select("doc_id", F.concat(F.lit("Unresolved extraction issue: "), "issue_id").alias("error"))
    errors = wrong.unionByName(issues)
    n = errors.count()
    return {"ok": n == 0, "documents": split.count(), "n_errors": n, "errors": _rows(errors.orderBy("doc_id", "error"), args.limit)}


def _outline(spark: SparkSession, args: argparse.Namespace) -> dict:
    found = views.outline(files.fragments_of(_read(spark, args.ledger)))
    return {"n": found.count(), "headings": _rows(found.orderBy("doc_id", "ord"), args.limit)}


def _search(spark: SparkSession, args: argparse.Namespace) -> dict:
    blocks = files.fragments_of(_read(spark, args.ledger)).withColumn("target", F.lit(None).cast("string"))
    found = views.search(blocks, args.words)
    shown = found.select("doc_id", "ord", "block_id", "kind", F.substring("text", 1, views.PREVIEW).alias("text"))
    return {"n": found.count(), "blocks": _rows(shown.orderBy("doc_id", "ord"), args.limit)}


def _candidates(spark: SparkSession, args: argparse.Namespace) -> dict:
    _guard(args.out, args.lines)
    if args.preview:
        _guard(args.preview, args.lines, args.out)
    lines = _read(spark, args.lines)
    layout.candidates(lines).write.mode("overwrite").parquet(args.out)
    found = _read(spark, args.out)
    if args.preview:
        views.preview(found).write.mode("overwrite").parquet(args.preview)
    used = ledger.coverage(lines, found.select("doc_id", F.explode("atom_ids").alias("atom_id")), ["doc_id", "atom_id"])
    states = {r["status"]: r["n"] for r in used.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most four rows
    spots = {r["flag"]: r["n"] for r in layout.hard_spot_counts(found).collect()}  # a row for each kind of flag
    return {"atoms": sum(states.values()), "candidates": found.count(), "coverage_ok": set(states) <= {"ok"}, "hard_spot_counts": spots}


_COMMANDS = {"import": (_import, ["files", "ledger"]), "check": (_check, ["ledger"]), "outline": (_outline, ["ledger"]), "search": (_search, ["ledger", "words"]), "candidates": (_candidates, ["lines", "out"])}


def run(argv: list[str], spark: SparkSession | None = None) -> tuple[int, str]:
    """The exit code and what is printed."""
    parser = argparse.ArgumentParser(prog="folium", description="Ledgers of documents as JSON")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, names) in _COMMANDS.items():
        command = commands.add_parser(name)
        for argument in names:
            command.add_argument(argument)
        command.add_argument("--pretty", action="store_true")
        command.add_argument("--limit", type=int, default=LIMIT)
        if name == "candidates":
            command.add_argument("--preview")
    args = parser.parse_args(argv)
    try:
        result = _COMMANDS[args.command][0](spark or SparkSession.builder.appName("folium").getOrCreate(), args)
    except Exception as error:  # the command line's contract: an error is an object too
        return 1, as_json({"ok": False, "error": str(error).split("\n")[0]}, args.pretty)
    failed = args.command == "check" and not result["ok"]
    return 2 if failed else 0, as_json({"ok": True, "result": result}, args.pretty)

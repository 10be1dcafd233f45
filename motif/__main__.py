"""python -m motif init|start|mcp|mine|search|list|stats: the miner, the registry and the tool server from the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from motif.api import Library
from motif.functions import exprs
from motif.functions.parse import parse_files
from motif.operators import crystallize, patterns, registry, search
from motif.schema import Settings
from motif.server import Server
from motif.sources import files, sinks
from motif.streaming.agent import start


def init(directory: str, skills: str) -> list[str]:
    """Folders and the editor's entry for the tool server; what is there stays. Returns the files made."""
    top, made = Path(directory), []
    Path(skills).mkdir(parents=True, exist_ok=True)
    (top / ".vscode").mkdir(parents=True, exist_ok=True)
    entry = {"command": sys.executable, "args": ["-m", "motif", "--skills", str(Path(skills).resolve()), "mcp"]}
    for path, key in ((top / ".cursor" / "mcp.json", "mcpServers"), (top / ".vscode" / "mcp.json", "servers")):
        if not path.exists():
            path.parent.mkdir(exist_ok=True)
            path.write_text(json.dumps({key: {"motif": entry}}, indent=2), encoding="utf-8")
            made.append(str(path))
    return made


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="motif", description=__doc__)
    parser.add_argument("--skills", default="skills", help="folder of skills")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("search")
    one.add_argument("query")
    one.add_argument("-k", type=int, default=Settings().max_results)
    one.add_argument("--mode", choices=("auto", "keyword", "tfidf"), default="auto")
    one = commands.add_parser("list")
    one.add_argument("--category")
    commands.add_parser("stats")
    one = commands.add_parser("mine")
    one.add_argument("dirs", nargs="+")
    commands.add_parser("mcp", help="serve assistants on standard input and output")
    one = commands.add_parser("start", help="watch directories and learn from saves")
    one.add_argument("dirs", nargs="*", default=["."])
    one.add_argument("--state", default=".motif/state", help="where counts are kept between runs")
    one.add_argument("--backfill", action="store_true", help="also learn from what is there")
    one.add_argument("--quiet", type=float, default=0.0, help="seconds without a change after which a file counts as saved")
    one.add_argument("--seconds", type=float, help="stop after so long")
    one = commands.add_parser("init", help="prepare a project")
    one.add_argument("directory", nargs="?", default=".")
    args = parser.parse_args(argv)
    if args.command == "init":
        print("\n".join(init(args.directory, args.skills)))
        return
    spark = SparkSession.builder.appName("motif").getOrCreate()
    if args.command == "mine":
        found = patterns.candidates(parse_files(files.as_events(files.decoded(files.scan(spark, args.dirs)))))
        sinks.write_tree(registry.skill_files(crystallize.crystallize(found).drop("code_valid")), args.skills)
        return
    if args.command in ("mcp", "start"):
        settings = Settings.from_environment()
        model = crystallize.offline if settings.backend == "offline" else crystallize.patient(crystallize.http_model(settings.backend, os.environ.get("MOTIF_KEY", ""), settings.model))
        library = Library(spark, args.skills, settings, model)
        if args.command == "mcp":
            Server(library).serve(sys.stdin, sys.stdout)
            return
        print(f"watching {', '.join(args.dirs)}; skills in {args.skills}; {crystallize.active_model(settings)}", flush=True)
        running = start(library, [str(Path(d).resolve()) for d in args.dirs], str(Path(args.state).resolve()), args.backfill, quiet=args.quiet)
        try:
            running.awaitTermination(*[args.seconds] * (args.seconds is not None))
        except KeyboardInterrupt:
            print("stopped")
        running.stop()
        return
    skills = files.read_skills(spark, args.skills)
    if args.command == "search":
        search.search(skills, args.query, args.k, args.mode).select("skill_name", "category", "score", exprs.shorten(F.col("description")).alias("description")).show(truncate=False)
    elif args.command == "list":
        kept = skills.where(F.col("category") == args.category) if args.category else skills
        kept.select("skill_name", "category", "language", "frequency", exprs.shorten(F.col("description")).alias("description")).orderBy("skill_name").show(1000, truncate=False)
    else:
        registry.totals(skills, "frequency").show()
        registry.count_by(skills, "category").orderBy(F.desc("n"), "category").show(100, truncate=False)
        registry.count_by(skills, "language").orderBy("language").show()
        registry.most_frequent(skills, "frequency", "skill_name").select("skill_name", "frequency").show(truncate=False)


if __name__ == "__main__":
    main()

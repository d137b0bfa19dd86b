"""Command line: ``python -m medspan`` with ``build-index``, ``infer`` or ``serve``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from medspan.plans.annotate import Options, annotate
from medspan.serve import server
from medspan.sources.index import DIMS, MAX_ALIASES, build_index, load_index
from medspan.sources.results import file_notes, result_json, text_notes


INDEX_DIR = "artifacts/index"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="medspan")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-index", help="build index tables from a terminology release")
    build.add_argument("--rrf-dir", help="folder that holds the release's names file (*CONSO.RRF) and relations file (*REL.RRF)")
    build.add_argument("--names-file")
    build.add_argument("--relations-file")
    build.add_argument("--source", required=True, help="abbreviation of the source whose rows are used")
    build.add_argument("--out-dir", default=INDEX_DIR)
    build.add_argument("--dims", type=int, default=DIMS)
    build.add_argument("--max-aliases-per-concept", type=int, default=MAX_ALIASES)
    build.add_argument("--max-concepts", type=int)
    build.add_argument("--max-rel-lines", type=int)
    build.add_argument("--reach-depth", type=int, default=0, help="also build the closures of all concepts to this depth, to be looked up")
    infer = commands.add_parser("infer", help="annotate a text or text files")
    source = infer.add_mutually_exclusive_group(required=True)
    source.add_argument("--text")
    source.add_argument("--text-file")
    serve = commands.add_parser("serve", help="answer requests over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    defaults = Options()
    for command in (infer, serve):
        command.add_argument("--index-dir", default=INDEX_DIR)
        for name in ("top_k", "max_graph_depth", "max_ngram", "max_exact_candidates"):
            command.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(defaults, name))
        command.add_argument("--exact-boost", type=float, default=defaults.exact_boost)
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "build-index":
        names, relations = args.names_file, args.relations_file
        if args.rrf_dir:
            names, relations = names or f"{args.rrf_dir}/*CONSO.RRF", relations or f"{args.rrf_dir}/*REL.RRF"
        if not (names and relations):
            top.error("give --rrf-dir, or --names-file and --relations-file")
    spark = SparkSession.builder.appName("medspan").getOrCreate()
    if args.command == "build-index":
        made = build_index(spark, names, relations, args.out_dir, args.source, args.dims, args.max_aliases_per_concept, args.max_concepts, args.max_rel_lines, args.reach_depth)
        print(json.dumps(made, indent=2))
        return 0
    options = Options(args.top_k, args.exact_boost, args.max_graph_depth, args.max_ngram, args.max_exact_candidates)
    if args.command == "serve":
        with server(load_index(spark, args.index_dir), args.index_dir, options, args.host, args.port) as running:
            running.serve_forever()
    notes = text_notes(spark, args.text) if args.text is not None else file_notes(spark, args.text_file)
    for row in result_json(annotate(notes, load_index(spark, args.index_dir), options)).toLocalIterator():
        print(json.dumps(json.loads(row["value"]), indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

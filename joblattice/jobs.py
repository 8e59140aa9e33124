"""spark-submit entry point: ingest, query and stats over a store folder."""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import DataFrame

from joblattice.operators import views
from joblattice.operators.enrich import ROLE_WORDS, SKILLS, enrich
from joblattice.operators.stats import stats
from joblattice.plans.adapters import ALL_SOURCES, DEFAULT_SOURCES, raw_listings
from joblattice.plans.answers import answer_questions
from joblattice.plans.ingest import default_embedder, ingest_batch
from joblattice.schema import EMBEDDING_DIMS, MIN_CONFIDENCE
from joblattice.session import build_session
from joblattice.sources.store import read_captures, read_captures_stream, read_listings, read_runs
from joblattice.streaming.ingest import ingest_captures_stream


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Job-listing analytics")
    parser.add_argument("--store", required=True, help="folder of the listing tables")
    parser.add_argument("--dims", type=int, default=EMBEDDING_DIMS)
    commands = parser.add_subparsers(dest="command", required=True)

    ingest = commands.add_parser("ingest", help="captured responses to listings")
    ingest.add_argument("--captures", required=True)
    ingest.add_argument("--role", required=True)
    ingest.add_argument("--sources", nargs="+", default=list(DEFAULT_SOURCES), choices=ALL_SOURCES)
    ingest.add_argument("--run-id")
    ingest.add_argument("--min-confidence", type=float, default=MIN_CONFIDENCE)
    ingest.add_argument("--skills", nargs="+", help="skills to look for, in place of the built-in ones")
    ingest.add_argument("--role-words", nargs="+", help="words of the role, in place of the built-in ones")
    ingest.add_argument("--checkpoint", help="stream the captures, with this checkpoint folder")

    query = commands.add_parser("query", help="answer a question")
    query.add_argument("--q", required=True)

    commands.add_parser("stats", help="counts, top skills and the last runs")
    return parser


def _show(rows: DataFrame) -> None:
    for line in rows.toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    spark = build_session()
    embedder = default_embedder(args.dims)
    if args.command == "ingest":
        skills, words = args.skills or SKILLS, args.role_words or ROLE_WORDS
        options = {
            "embedder": embedder,
            "min_confidence": args.min_confidence,
            "enricher": lambda rows: enrich(rows, skills, words),
        }
    if args.command == "ingest" and args.checkpoint:
        ingest_captures_stream(
            read_captures_stream(spark, args.captures), args.role, args.store, args.checkpoint, args.sources,
            **options,
        ).awaitTermination()
    elif args.command == "ingest":
        raw, fetched = raw_listings(read_captures(spark, args.captures), args.role, args.sources)
        run_id = args.run_id or str(uuid.uuid4())
        _show(
            ingest_batch(
                raw, args.store, run_id, fetched=fetched, **options,
            )
        )
        print(json.dumps({"run_id": run_id, "status": "completed", "sources": args.sources}))
    elif args.command == "query":
        question = spark.createDataFrame([(0, args.q)], "question_id int, question string")
        answers = answer_questions(question, read_listings(spark, args.store), embedder)
        _show(answers.select("answer", "sources"))
    else:
        _show(stats(read_listings(spark, args.store), views.last_runs(read_runs(spark, args.store))))


if __name__ == "__main__":
    main()

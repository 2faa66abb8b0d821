"""Command line: build a graph from documents, or ask one.

python -m chronolith build --corpus DOCS --working-dir GRAPH [--config FILE] [--num-docs N]
python -m chronolith ask "QUESTION" --working-dir GRAPH [--mode local|global|naive] [--config FILE]
"""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronolith")
    sub = p.add_subparsers(dest="command", required=True)
    build, ask = sub.add_parser("build"), sub.add_parser("ask")
    for s in (build, ask):
        s.add_argument("--config")
        s.add_argument("--working-dir")
    build.add_argument("--corpus", dest="corpus_path")
    build.add_argument("--num-docs", type=int, default=3)
    build.add_argument("--chunk-size", type=int)
    build.add_argument("--chunk-overlap", type=int)
    ask.add_argument("question")
    ask.add_argument("--mode", choices=["local", "global", "naive"])
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--only-context", action="store_const", const=True)
    return p


def main(argv: list[str] | None = None, spark=None) -> str | int:  # noqa: ANN001
    from chronolith.plans import settings
    from chronolith.sources import files

    args = vars(parser().parse_args(argv))
    command, config = args.pop("command"), args.pop("config")
    loaded = settings.load(config, "building" if command == "build" else "querying", args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("chronolith").getOrCreate()
    graph = settings.engine(spark, loaded)
    if command == "build":
        made = graph.insert(files.documents(spark, loaded.core.corpus_path, args["num_docs"]))
        print(f"{made} new chunks")
        return made
    answer = graph.query(args["question"], loaded.query)
    print(answer)
    return answer


if __name__ == "__main__":
    main()

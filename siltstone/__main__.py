"""Command line: parse, chunk, embed, index, query, context, eval, compare, smoke, serve."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from siltstone.config import load_settings
from siltstone.session import build_session


def smoke(spark) -> int:
    """0 if a text that was indexed is found, packed and labelled."""
    from siltstone.engine import Engine
    from siltstone.session import scratch_path

    with tempfile.TemporaryDirectory(prefix="siltstone-smoke-") as folder:
        for name, text in (("a.txt", "Pumps move water uphill."), ("b.md", "# Sails\n\nWind moves ships."), ("c.csv", "name,role\nAda,engineer\n")):
            Path(folder, name).write_text(text, encoding="utf-8")
        engine = Engine(spark, scratch_path(spark, "smoke"))
        summary, _ = engine.index(folder)
        packed = engine.context(["wind moves ships"], mode="hybrid").first()
    fine = summary.get("new") == 3 and "Wind moves ships." in (packed["context"] or "") and packed["label"] != "empty"
    print(json.dumps({"indexed": summary.get("new"), "label": packed["label"], "ok": fine}))
    return 0 if fine else 1


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone")
    parser.add_argument("--root", default="siltstone_index", help="folder of the index")
    parser.add_argument("--config", help="YAML file with settings")
    parser.add_argument("--collection")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "chunk", "embed", "index"):
        commands.add_parser(name).add_argument("path")
    for name in ("query", "context"):
        command = commands.add_parser(name)
        command.add_argument("text", nargs="+")
        command.add_argument("--mode", choices=("vector", "bm25", "hybrid"))
        command.add_argument("--top-k", type=int)
        command.add_argument("--rerank", action="store_true", default=None)
    evaluate = commands.add_parser("eval")
    evaluate.add_argument("qrels")
    evaluate.add_argument("--report", default="report.json")
    compare = commands.add_parser("compare", help="judged queries with and without reranking over one index")
    compare.add_argument("qrels")
    compare.add_argument("--report", default="compare.json")
    commands.add_parser("smoke", help="index a few texts in a scratch folder and ask for one of them")
    serve = commands.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--api-key")
    args = parser.parse_args(arguments)

    from siltstone.engine import Engine, load_qrels

    spark = build_session()
    root = args.root if "://" in args.root else f"file://{Path(args.root).resolve()}"
    engine = Engine(spark, root, load_settings(args.config))
    show = lambda rows: [print(r) for r in rows.toJSON().collect()]
    if args.command in ("parse", "chunk", "embed"):
        from pyspark.sql import functions as F

        from siltstone.operators.chunking import chunk_documents
        from siltstone.sources import files

        parsed = files.parse(files.read_files(spark, [Path(args.path).resolve()]))
        if error := parsed.first()["error"]:
            print(error, file=sys.stderr)
            return 1
        rows = parsed.select(F.col("path").alias("doc_id"), F.inline("blocks"))
        if args.command != "parse":
            rows = chunk_documents(rows, parsed.select(F.col("path").alias("doc_id"), "raw_text"))
        if args.command == "embed":
            rows = rows.filter("role = 'child'").select("chunk_id", engine.provider.expression("text").alias("vector"))
        show(rows)
    elif args.command == "index":
        summary, results = engine.index(args.path, args.collection)
        show(results.filter("status = 'failed'"))
        print(json.dumps(summary))
    elif args.command in ("query", "context"):
        how = {"mode": args.mode, "top_k": args.top_k, "rerank": args.rerank, "collection": args.collection}
        show(engine.retrieve(args.text, **how).orderBy("query_id", "rank") if args.command == "query" else engine.context(args.text, **how))
    elif args.command == "eval":
        metrics, summary = engine.evaluate(load_qrels(spark, args.qrels), collection=args.collection)
        engine.report(metrics, args.report)
        show(summary)
    elif args.command == "compare":
        judged, found = load_qrels(spark, args.qrels), {}
        for name, rerank in (("plain", False), ("reranked", True)):
            metrics, summary = engine.evaluate(judged, collection=args.collection, rerank=rerank)
            found[name] = engine.report(metrics, Path(args.report).with_suffix(f".{name}.json"), suite=name)["modes"]
            show(summary)
        gains = {m: {k: found["reranked"][m][k] - v for k, v in means.items() if isinstance(v, float)} for m, means in found["plain"].items()}
        Path(args.report).write_text(json.dumps({"gain": gains} | found, indent=2), encoding="utf-8")
    elif args.command == "smoke":
        return smoke(spark)
    else:
        from siltstone.service import serve_forever

        serve_forever(engine, args.host, args.port, args.api_key)
    return 0


if __name__ == "__main__":
    sys.exit(main())

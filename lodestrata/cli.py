"""python -m lodestrata.cli: settings, indexing of source trees, evaluation, calls of the query surface."""

from __future__ import annotations

import argparse
import json
import os
import sys

SOURCES = ("modding", "blog", "support", "server")
CORPORA = ("code", "gamedata", "client", "docs")
#: Environment variables that go before the settings file, which goes before defaults.
ENVIRONMENT = {"LODESTRATA_PROVIDER": "provider", "LODESTRATA_URL": "url", "LODESTRATA_API_KEY": "api_key", "LODESTRATA_MODEL": "model", "LODESTRATA_DIMENSIONS": "dimensions", "LODESTRATA_ROOT": "root", "LODESTRATA_VERSION": "version"}
DEFAULTS = {"provider": "hashing", "url": None, "api_key": None, "model": None, "dimensions": 64, "root": ".", "version": "release", "reranker": None}


def settings(path: str | None, environment: dict[str, str] | None = None) -> dict:
    """Defaults, then the file's values, then the environment's."""
    out = dict(DEFAULTS)
    if path and os.path.exists(path):
        with open(path) as f:
            out |= {k: v for k, v in json.load(f).items() if k in DEFAULTS}
    for name, key in ENVIRONMENT.items():
        if value := (environment if environment is not None else os.environ).get(name):
            out[key] = int(value) if key == "dimensions" else value
    return out


def _listed(known: tuple[str, ...]):
    def parse(text: str) -> list[str]:
        asked = list(known) if text == "all" else text.split(",")
        if bad := [a for a in asked if a not in known]:
            raise argparse.ArgumentTypeError(f"unknown: {', '.join(bad)}")
        return asked

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodestrata")
    p.add_argument("--config", default="lodestrata.json")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    for name in ("provider", "url", "api-key", "model", "root", "reranker"):
        init.add_argument(f"--{name}")
    init.add_argument("--dimensions", type=int)
    init.add_argument("--force", action="store_true")
    index = sub.add_parser("index")
    index.add_argument("--source", required=True)
    index.add_argument("--out", required=True)
    index.add_argument("--slug", required=True)
    index.add_argument("--corpus", type=_listed(CORPORA), default=list(CORPORA))
    index.add_argument("--docs-source", type=_listed(SOURCES), default=list(SOURCES))
    ev = sub.add_parser("eval")
    ev.add_argument("--golden", required=True)
    ev.add_argument("--baseline", type=float)
    ev.add_argument("--sweep", help='JSON of axes, e.g. {"name_weight": [5, 10]}')
    tool = sub.add_parser("call")
    tool.add_argument("tool")
    tool.add_argument("arguments", nargs="?", default="{}")
    return p


def index_tree(spark, source: str, slug: str, corpora: list[str], docs_sources: list[str]):
    """{corpus: nodes or error} of a source tree with folders java, assets, ui and docs/<source>."""
    from pyspark.sql import functions as F

    from lodestrata.operators.store import index_corpora
    from lodestrata.sources import docs, files, java, json_records, ui

    def shaped(df, corpus, **columns):
        names = ("id", "node_type", "display_name", "path", "line_start", "line_end", "content", "embedding_text", "metadata", "data_type", "published_date")
        have = df.withColumns({k: F.lit(v) for k, v in columns.items()})
        return have.select(F.lit(slug).alias("slug"), *(F.col(n) if n in have.columns else F.lit(None).cast("int" if n.startswith("line") else "string").alias(n) for n in names), F.lit(corpus).alias("corpus"), F.col("path").alias("owning_file")).withColumnRenamed("path", "file_path")

    build = {
        "code": lambda: shaped(java.java_nodes(files.read_tree(spark, [f"{source}/java"], "*.java")), "code"),
        "gamedata": lambda: shaped(json_records.game_nodes(files.read_tree(spark, [f"{source}/assets"], "*.json")), "gamedata", node_type="GameData"),
        "client": lambda: shaped(ui.ui_nodes(files.read_tree(spark, [f"{source}/ui"])), "client"),
        "docs": lambda: shaped(_union([docs.docs_nodes(files.read_tree(spark, [f"{source}/docs/{s}"], "*.md*"), s) for s in docs_sources if os.path.isdir(f"{source}/docs/{s}")]), "docs", node_type="DocsPage"),
    }
    return index_corpora({c: build[c] for c in corpora})


def _union(parts: list):
    if not parts:
        raise LookupError("no docs found")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate(engine, golden: list[dict], tool_of) -> dict:
    """Mean metrics of golden queries, by tool and overall."""
    from lodestrata.operators import evaluation as E

    spark = engine.spark
    ranked, expected = [], []
    for n, g in enumerate(golden):
        for r in tool_of(engine, g["tool"], g["query"]).select("node_id", "rank").collect():
            ranked.append((n, int(r["rank"]), r["node_id"]))
        expected += [(n, g["tool"], e) for e in g["expectedIds"]]
    want = spark.createDataFrame(expected, "query_id int, tool string, expected string")
    metrics = E.query_metrics(want.select("query_id", "expected"), spark.createDataFrame(ranked, "query_id int, rank int, node_id string"))
    tools = want.select("query_id", "tool").distinct()
    by_tool = E.mean_metrics(metrics.join(tools, "query_id"), ("tool",))
    return {"overall": E.mean_metrics(metrics).collect()[0].asDict(), "by_tool": [r.asDict() for r in by_tool.collect()]}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init":
        if os.path.exists(args.config) and not args.force:
            print(f"{args.config} exists; --force replaces it", file=sys.stderr)
            return 1
        given = {k: v for k, v in vars(args).items() if k in DEFAULTS and v is not None}
        with open(args.config, "w") as f:
            json.dump(DEFAULTS | given, f, indent=2)
        return 0
    from lodestrata.engine import Engine, call
    from lodestrata.operators import evaluation as E
    from lodestrata.session import session

    conf, spark = settings(args.config), session()
    if args.command == "index":
        from lodestrata.operators.store import write_nodes

        done = index_tree(spark, args.source, args.slug, args.corpus, args.docs_source)
        for corpus, nodes in done.items():
            try:
                if isinstance(nodes, Exception):
                    raise nodes
                write_nodes(nodes, args.out)
            except Exception as e:  # noqa: BLE001
                done[corpus] = e
                print(f"{corpus}: {str(e)[:300]}", file=sys.stderr)
        return int(any(isinstance(x, Exception) for x in done.values()))
    engine = Engine(spark, conf["root"], conf["version"])
    if args.command == "call":
        out = call(engine, args.tool, json.loads(args.arguments))
        print(out.get("content") or out["error"])
        return int("error" in out)
    with open(args.golden) as f:
        golden = [json.loads(line) for line in f if line.strip()]
    search = lambda e, tool, q: {"search_code": lambda: e.search_code(q, 10), "search": lambda: e.search(q, 10)}.get(tool, lambda: e.search_corpus(q, tool.removeprefix("search_"), 10))()
    grid = E.sweep_grid(json.loads(args.sweep)) if args.sweep else [{}]
    results = [{"settings": s} | evaluate(engine.with_settings(**s), golden, search) for s in grid]
    best = max(results, key=lambda r: r["overall"]["recall_at_5"] * 1000 + r["overall"]["mrr"])
    print(json.dumps(best if len(grid) > 1 else results[0]))
    return int(not E.passes(best["overall"]["recall_at_5"], args.baseline))


if __name__ == "__main__":
    sys.exit(main())

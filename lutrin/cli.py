"""Command line: ingest, ask, eval, inspect, patch-families, serve."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
import threading
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin import answers, config
from lutrin.functions import text as X
from lutrin.operators import encoders, reports
from lutrin.plans.build import build, patch_families, stored_index
from lutrin.plans.scale import written
from lutrin.plans.search import Searcher
from lutrin.sources import files
from lutrin.sources.store import Store

EXTRACTORS = {".pdf": files.pdf_pages, ".txt": files.plain_pages}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lutrin", description="Document retrieval on Spark")
    p.add_argument("--docs", default="documents")
    p.add_argument("--index", default="index")
    p.add_argument("--kind", default=".pdf", choices=sorted(EXTRACTORS))
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="bring the index up to date")
    a.add_argument("--max-files", type=int)
    a.add_argument("--workers", type=int, help="tasks that read files at a time")
    a.add_argument("--rebuild", action="store_true")
    a.add_argument("--family", nargs="+", metavar="FAMILY")
    a = sub.add_parser("ask", help="search one question")
    a.add_argument("question")
    a.add_argument("--top-k", type=int)
    a.add_argument("--family", nargs="+", metavar="FAMILY")
    a.add_argument("--expand-query", action="store_true", help="let the backend name codes to search beside the question")
    a.add_argument("--expansion", default="", help="words to search beside the question")
    a.add_argument("--alpha", type=float, default=0.5)
    a.add_argument("--backend")
    a.add_argument("--no-llm", action="store_true")
    a.add_argument("--debug", action="store_true")
    a = sub.add_parser("eval", help="score a golden question set")
    a.add_argument("--dataset", required=True)
    a.add_argument("--ids", nargs="+")
    a.add_argument("--top-k", type=int, default=8)
    a.add_argument("--backend")
    a.add_argument("--timeout", type=float, default=120, help="seconds a question's answer may take")
    a.add_argument("--expand-query", action="store_true", help="also with expanded questions, compared with the plain run")
    a.add_argument("--alpha", type=float, default=0.5)
    a.add_argument("--multi-alpha", action="store_true", help="plain, then expanded at 0.7 and 0.5")
    a.add_argument("--no-llm", action="store_true")
    a.add_argument("--output", default="results")
    a = sub.add_parser("inspect", help="chunks of one file")
    a.add_argument("file")
    sub.add_parser("patch-families", help="recompute the family of stored chunks")
    a = sub.add_parser("serve", help="HTTP service")
    a.add_argument("--port", type=int, default=8000)
    return p


class Engine:
    """A resident index: the stored tables of the current version, cached for repeated questions."""

    def __init__(self, spark: SparkSession, store: Store, settings: config.Settings, encoder=None):
        self.spark, self.settings, self.encoder = spark, settings, encoder or encoders.encoder(settings.embedding_model)
        version = store.current()
        ix = stored_index(store, version)
        for df in (ix.docs, ix.terms, ix.stats):
            df.persist()
        self.searcher = Searcher(store.table("chunks", True, version).persist(), store.table("vectors", True, version).persist(), settings, ix)

    def questions(self, rows: list[tuple[str, str, str]]) -> DataFrame:
        q = self.spark.createDataFrame(rows, "query_id string, text string, expansion string")
        v = encoders.encode(q, "query_id", "text", self.encoder)
        e = encoders.encode(q, "query_id", "expansion", self.encoder).withColumnRenamed("embedding", "expansion_embedding")
        return q.join(v, "query_id").join(e, "query_id")

    def hits(self, question: str, top_k=None, families=None, expansion: str = "", alpha=None) -> DataFrame:
        q = self.questions([("q", question, expansion)])
        if expansion.strip():
            return self.searcher.search_weighted(q, top_k, alpha, families)
        return self.searcher.search(q.select("query_id", "text", "embedding"), top_k, families)

    def expansions(self, asked: list[tuple[str, str]], backend: str) -> dict[str, list[str]]:
        """Codes that the backend names for each question; none where it fails."""
        q = self.spark.createDataFrame(asked, "query_id string, text string")
        return {r["query_id"]: list(r["codes"]) for r in answers.expanded(q, answers.expander(backend, self.settings)).collect()}  # a stated question set


EMPTY = "id string, shown string, answer string, expansion string, codes array<string>, error string"


def evaluate(engine: Engine, golden: DataFrame, top_k: int, answerer: answers.Answerer | None, backend: str | None = None, alpha: float | None = None) -> DataFrame:
    """Golden cases with scores. The questions of one family filter are searched in one batch, with the codes that
    `backend` names for them if it is given. A case whose search or answer fails scores nothing and keeps its error."""
    cases = [r.asDict() for r in golden.select("id", "question", "family").collect()]  # a stated question set
    codes = engine.expansions([(c["id"], c["question"]) for c in cases], backend) if backend else {}
    out = []
    for wanted in sorted({c["family"] or "" for c in cases}):
        mine = [c for c in cases if (c["family"] or "") == wanted]
        shown, prompt, failed = {}, {}, None
        try:
            q = engine.questions([(c["id"], c["question"], " ".join(codes.get(c["id"], []))) for c in mine])
            hits = engine.searcher.search_weighted(q, top_k, alpha, [wanted] if wanted else None).persist()
            shown = {r["query_id"]: r["passages"] for r in reports.passages(hits).collect()}
            prompt = {r["query_id"]: r["user"] for r in reports.prompts(hits, q.select("query_id", "text")).collect()} if answerer else {}
        except Exception as e:  # noqa: BLE001 - the other families' questions are still worth their scores
            failed = str(e)
        for c in mine:
            said, error = "", failed
            if c["id"] in prompt:
                try:
                    said = answerer(answers.SYSTEM, prompt[c["id"]])
                except Exception as e:  # noqa: BLE001 - one case must not end the run
                    error = str(e)
            names = [] if error else codes.get(c["id"], [])
            out.append((c["id"], "" if error else shown.get(c["id"], "No relevant passages found."), said, " ".join(names), names, error))
    got = engine.spark.createDataFrame(out, EMPTY).withColumnRenamed("shown", "passages")
    return reports.scored(golden.join(got, "id")).withColumn("alpha", F.lit(alpha if backend else None).cast("double"))


def summary(results: DataFrame) -> list[str]:
    line = F.concat_ws("  ", "id", X.abbreviated(F.col("question"), 52), F.format_string("%3.0f%%", F.col("retrieval_score") * 100), X.bar(F.col("retrieval_score")), F.format_string("%3.0f%%", F.col("answer_score") * 100), X.bar(F.col("answer_score")))
    lost = F.concat_ws(", ", F.col("missing_articles"), F.col("missing_keywords"))
    rows = results.orderBy("id").select(line.alias("l"), lost.alias("m"), "error").collect()
    means = results.agg(F.avg("retrieval_score").alias("r"), F.avg("answer_score").alias("a")).first()
    out = [x for r in rows for x in [r["l"], *([f"    missing: {r['m']}"] if r["m"] else []), *([f"    error: {r['error']}"] if r["error"] else [])]]
    return [*out, f"mean  {means['r']:.0%}  {means['a']:.0%}"]


def comparison(runs: list[tuple[str, DataFrame]]) -> list[str]:
    """Retrieval of each case in every run, against the first."""
    together = None
    for name, df in runs:
        r = df.select(F.lit(name).alias("run"), "id", "retrieval_score")
        together = r if together is None else together.unionByName(r)
    cells: dict[str, dict[str, str]] = {}
    show = F.concat_ws(" ", F.format_string("%3.0f%%", F.col("retrieval_score") * 100), X.bar(F.col("retrieval_score"), 6), "arrow", F.format_string("%.0f%%", F.abs(F.col("delta")) * 100))
    for r in reports.compared(together, runs[0][0]).select("id", "run", show.alias("c")).collect():
        cells.setdefault(r["id"], {})[r["run"]] = r["c"]
    return ["  ".join(["id", *[n for n, _ in runs]]), *["  ".join([i, *[cells[i][n] for n, _ in runs]]) for i in sorted(cells)]]


@contextlib.contextmanager
def heartbeat(spark: SparkSession, seconds: float = 15.0):
    """Tell every so often how many tasks of the running stages are done."""
    stop, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def beat() -> None:
        while not stop.wait(seconds):
            stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
            print(f"{datetime.now():%H:%M:%S} working: {sum(s.numCompletedTasks for s in stages)} of {sum(s.numTasks for s in stages)} tasks", flush=True)

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()


def ingest(spark: SparkSession, args, settings: config.Settings, store: Store) -> None:
    listed = files.listing(spark, args.docs, f"*{args.kind}", settings.max_files)
    failed: list[tuple[str, str]] = []

    def read(wanted: DataFrame) -> DataFrame:
        # Read once: the pages, and one row for each file that could not be read.
        got = written(files.pages(spark, args.docs, wanted, EXTRACTORS[args.kind], f"*{args.kind}", args.workers), "pages")
        failed.extend((r["source_path"], r["error"]) for r in got.where("error IS NOT NULL").select("source_path", "error").limit(1000).collect())
        n = got.where("error IS NOT NULL").count()
        if n:
            print(f"{n} files could not be read", file=sys.stderr)
        return got.where("error IS NULL")

    encoder = lambda chunks: encoders.encode(chunks, "chunk_ord", "content", encoders.encoder(settings.embedding_model))
    with heartbeat(spark):
        n, m = build(store, listed, read, settings, args.rebuild, args.family, encoder, lambda part, size: print(f"{datetime.now():%H:%M:%S} {part}: {size}", flush=True))
    for path, error in failed:  # at most 1,000 are named, all are counted
        print(f"skipped {path}: {error}", file=sys.stderr)
    print(f"{n} files, {m} chunks")


def ask(engine: Engine, args) -> None:
    settings = engine.settings
    backend, expansion = args.backend or settings.llm_backend, args.expansion
    if args.expand_query and (codes := engine.expansions([("q", args.question)], backend)["q"]):
        expansion = " ".join(codes)
        print(f"{reports.CODES_MARK}{codes}\n{reports.EXPANSION_MARK}{expansion}\n")
    hits = engine.hits(args.question, args.top_k, args.family, expansion, args.alpha).persist()
    if hits.isEmpty():
        print("No relevant passages found.")
        return
    if args.debug and not expansion.strip():
        for r in hits.orderBy("rank").select(reports.debug_line().alias("l")).collect():
            print(r["l"])
    print(f"{reports.PASSAGES_MARK}\n\n{reports.passages(hits).first()['passages']}")
    if args.no_llm:
        return
    q = engine.spark.createDataFrame([("q", args.question)], "query_id string, text string")
    try:
        print(f"\n{reports.ANSWER_MARK}\n\n{answers.answerer(backend, settings)(answers.SYSTEM, reports.prompts(hits, q).first()['user'])}")
    except RuntimeError as e:
        raise SystemExit(str(e)) from e


def evaluation(engine: Engine, args, golden: DataFrame) -> None:
    backend = args.backend or engine.settings.llm_backend
    say = None if args.no_llm else answers.answerer(backend, engine.settings, args.timeout)
    plan: list[tuple[str, float | None]] = [("plain", None)]
    if args.multi_alpha or args.expand_query:
        plan += [(f"alpha={a}", a) for a in ((0.7, 0.5) if args.multi_alpha else (args.alpha,))]
    runs = []
    Path(args.output).mkdir(parents=True, exist_ok=True)
    for name, alpha in plan:
        results = evaluate(engine, golden, args.top_k, say, None if alpha is None else backend, alpha).persist()
        print("\n".join([name, *summary(results)]))
        runs.append((name, results))
        out = Path(args.output) / f"results_{datetime.now():%Y%m%d_%H%M%S_%f}.json"
        out.write_text(json.dumps([json.loads(r) for r in results.toJSON().collect()], ensure_ascii=False, indent=2), encoding="utf-8")
    if len(runs) > 1:
        print("\n".join(comparison(runs)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "ingest" and args.family and not args.rebuild:
        raise ValueError("--family needs --rebuild")
    spark = spark or SparkSession.builder.appName("lutrin").getOrCreate()
    settings = config.load(top_k=getattr(args, "top_k", None), max_files=getattr(args, "max_files", None))
    store = Store(spark, args.index)
    if args.command == "ingest":
        ingest(spark, args, settings, store)
    elif args.command == "inspect":
        rows = store.table("chunks", True).where(X.basename(F.col("source_path")) == args.file).orderBy("chunk_ord")
        for r in rows.select("chunk_ord", "chunk_id", "page", "section", F.substring("content", 1, 300).alias("t")).toLocalIterator():
            print(f"#{r['chunk_ord']} {r['chunk_id']} page {r['page']} {r['section'] or ''}\n{r['t']}\n")
    elif args.command == "patch-families":
        for r in patch_families(store).collect():
            print(r["doc_family"], r["before"], "->", r["after"])
    elif args.command == "ask":
        ask(Engine(spark, store, settings), args)
    elif args.command == "eval":
        golden = spark.read.schema(reports.GOLDEN).option("multiLine", "true").option("mode", "FAILFAST").json(args.dataset)
        if args.ids:
            golden = golden.where(F.col("id").isin(args.ids))
        if golden.isEmpty():
            raise SystemExit("no case to evaluate")
        evaluation(Engine(spark, store, settings), args, golden)
    elif args.command == "serve":
        from lutrin.service import serve

        serve(Engine(spark, store, settings), args.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())

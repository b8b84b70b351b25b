"""``python -m spanloom``: chunk files, compare strategies, evaluate, judge and generate questions."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import jobs, reports
from .operators.judging import build_pairs
from .operators.strategies import STRATEGIES, chunk_documents
from .sources.corpus import zh_mini
from .sources.files import chunk_file, load_docs_dir, write_jsonl_file

DEMO = "# 山路\n清晨的雾还没有散。向导说：“沿着溪走。”我们走了三个小时，费用是每人40元。\n\n# 山顶\n风很大，云在脚下。没有人说话……\n"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    sizes = argparse.ArgumentParser(add_help=False)
    sizes.add_argument("--max-chars", type=int, default=500)
    sizes.add_argument("--overlap", type=int, default=50)
    one = commands.add_parser("file", parents=[sizes], help="chunk a text or Markdown file")
    one.add_argument("path")
    one.add_argument("--strategy", choices=[*STRATEGIES, "fixed-window"])
    one.add_argument("--explain", action="store_true")
    one.add_argument("--stats", action="store_true")
    one.add_argument("--compare", action="store_true")
    one.add_argument("--out", help="JSONL file instead of standard output")
    commands.add_parser("demo", parents=[sizes], help="chunk a built-in text")
    commands.add_parser("evaluate", parents=[sizes], help="report over the built-in corpus and its questions").add_argument("-k", type=int, default=3)
    speed = commands.add_parser("throughput", parents=[sizes], help="time every strategy over a folder, and count the rules of its boundaries")
    speed.add_argument("docs", help="folder of .txt and .md files")
    for name, text in (("report", "compare strategies over documents and questions"), ("judge", "judge pairs without a model"), ("qa", "generate questions without a model")):
        job = commands.add_parser(name, parents=[sizes], help=text)
        job.add_argument("docs", help="folder of .txt and .md files")
        job.add_argument("--questions", help="JSONL of doc_id, q_idx, q, gold")
        job.add_argument("--state", help="folder of the job's records")
        job.add_argument("--out", help="file for the report")
        job.add_argument("-k", type=int, default=3)
    return out


def _docs(spark, path):
    return load_docs_dir(spark, path).select(F.col("id").alias("doc_id"), "text")


def _questions(spark, path):
    return spark.read.schema("doc_id string, q_idx int, q string, gold string").json(path)


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    overlap = min(args.overlap, max(0, args.max_chars // 10))
    if args.command == "demo":
        rows = chunk_documents(spark.createDataFrame([("demo", DEMO)], "doc_id string, text string"), "markdown", max_chars=min(args.max_chars, 60), overlap_chars=min(overlap, 6), explain=True)
        return "\n".join(f"[{r['start']}:{r['end']}] {r['meta']['end_rule']}: {r['text']!r}" for r in rows.orderBy("seq").collect())
    if args.command == "file":
        if args.compare:
            docs = spark.read.text(args.path, wholetext=True).select(F.lit("file").alias("doc_id"), F.col("value").alias("text"))
            return reports.as_markdown(reports.compare_texts(docs, args.max_chars, overlap, overlap))
        params = {"max_chars": args.max_chars, "overlap_chars": overlap}
        if args.explain and args.strategy != "fixed-window":
            params["explain"] = True
        chunks = chunk_file(spark, args.path, args.strategy, **params)
        if args.stats:
            return reports.as_markdown(reports.chunk_stats(chunks))
        if args.out:
            return f"{write_jsonl_file(chunks, args.out)} chunks in {args.out}"
        return "\n".join(r["j"] for r in chunks.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator())
    if args.command == "evaluate":
        return reports.full_report(*zh_mini(spark), args.max_chars, args.overlap, sorted({1, args.k}))
    docs = _docs(spark, args.docs)
    if args.command == "throughput":
        rules = reports.rule_distribution(chunk_documents(docs, "recursive", max_chars=args.max_chars, overlap_chars=overlap, explain=True)).orderBy(F.desc("n"), "end_rule")
        return reports.as_markdown(reports.compare_texts(docs, args.max_chars, overlap)) + "\n" + reports.as_markdown(rules)
    if args.command == "qa":
        return json.dumps(vars(jobs.run_questions(docs, args.state)), ensure_ascii=False)
    questions = _questions(spark, args.questions)
    chunks = reports.strategy_chunks(docs, args.max_chars, overlap)
    if args.command == "judge":
        stats = jobs.run_judging(build_pairs(chunks, questions), args.state)
        return json.dumps(vars(stats), ensure_ascii=False) + "\n" + reports.as_markdown(jobs.summarize(spark, args.state))
    text = reports.full_report(docs, questions, args.max_chars, overlap, sorted({1, args.k}))
    if args.out:
        reports.write_report(text, args.out)
    return text


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("spanloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(run(args, spark))
        return 0
    except Exception as error:  # noqa: BLE001
        print(f"error: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())

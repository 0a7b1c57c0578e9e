"""Command line: python -m lexiloom.cli COMMAND. Documents are Parquet with doc_id and text, or a lake's catalog; "sample" stands for the sets that come with the library."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.operators import chunking, evaluation, index, mining, retrieval, vectors
from lexiloom.operators.analysis import Analyzer, catalog_text
from lexiloom.operators.config import AnalyzerConfig, Prescription
from lexiloom.operators.index import Engine
from lexiloom.plans import api, doctor, reports, scale, treatment
from lexiloom.plans.service import Executor, RepairService
from lexiloom.sources import files, lake, samples, search_server, synthetic
from lexiloom.sources.shared import written
from lexiloom.sources.store import PatchStore


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    docs = samples.load_catalog(spark) if path == "sample" else spark.read.parquet(path)
    return catalog_text(docs) if "text" not in docs.columns else docs


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    return samples.load_knowledge(spark) if path == "sample" else spark.read.parquet(path)


def read_evalset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON list of {query, family, expected_patch_kinds, qrels: {doc_id: grade}}, or the one that comes with the library: sample."""
    return samples.load_evalset(spark, samples.SAMPLES / "evalset.json" if path == "sample" else path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lexiloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *needs: str, **extra):
        c = sub.add_parser(name)
        for n in needs:
            c.add_argument(f"--{n}", required=True)
        for n, default in extra.items():
            c.add_argument(f"--{n.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        c.add_argument("--config", help="an analyzer configuration in JSON")
        c.add_argument("--output", help="a file for the report, else standard output")
        return c

    command("analyze", "text")
    command("search", "docs", "query", k=10)
    command("evaluate", "docs", "evalset")
    command("diagnose", "docs", "evalset", vectors=None)
    command("heal", "docs", "evalset", vectors=None, rules="scripted", ledger=None)
    command("treat", "docs", "evalset", "query", vectors=None, rules="scripted", knowledge=None)
    command("demo-trap", "docs", "evalset", "good", "broad")
    command("export-es", url=None, index="lexiloom", docs=None)
    command("build-vectors", "docs", "model")
    command("build-lake", "root", docs=5000, rows=500_000, days=7)
    command("mine-logs", "root", engine="spark", min_volume=3, limit=50, since=None, until=None)
    command("scale-bench", "docs", "evalset", "good", "broad", sizes="0,1000,10000", probe="팬")
    command("rag-eval", "docs", "evalset", "knowledge", vectors=None, k=3, chunking="none")
    command("baseline", "docs", "evalset", "file", action="check")
    command("vector-probe", "vectors", "pairs")
    command("es-verify", "docs", "evalset", "url", index="lexiloom")
    command("serve", "docs", "evalset", store=None, port=8000, protocol="http")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[str, bool]:
    """The report, and whether the command's check passed."""
    analyzer = Analyzer(AnalyzerConfig.from_json(Path(args.config).read_text()) if args.config else AnalyzerConfig())
    opt = vars(args).get
    engine = Engine(read_docs(spark, args.docs), analyzer) if isinstance(opt("docs"), str) else None
    if engine is not None:
        engine = Engine(engine.docs.withColumn("doc_id", F.col("doc_id").cast("string")), analyzer)
    queries, qrels = read_evalset(spark, args.evalset) if opt("evalset") else (None, None)
    cache = files.load_vectors_if_there(spark, args.vectors) if opt("vectors") else None
    c = args.command
    if c == "analyze":
        row = spark.createDataFrame([(args.text,)], "t string").select(analyzer.explain("t").alias("t"), analyzer.dropped("t").alias("d")).first()
        return reports.table(["token", "tag", "origin"], [tuple(t) for t in row.t]) + "".join(f"\ndropped: {t.form} ({t.tag})" for t in row.d), True
    if c == "search":
        hits = engine.search(spark.createDataFrame([(args.query,)], "query string"), args.k).orderBy("rank").collect()
        return reports.table(["rank", "doc_id", "score", "matched"], [(h.rank, h.doc_id, h.score, " ".join(h.matched_terms)) for h in hits]), True
    if c == "evaluate":
        rows = evaluation.means_by_health(evaluation.evaluate(engine, queries, qrels), queries).orderBy("segment").collect()
        return reports.table(["segment", "mean nDCG", "zero results", "queries"], [tuple(r) for r in rows]), True
    if c == "diagnose":
        rows = doctor.candidate_patches(engine, queries.where("family is not null"), cache, doctor.LADDER).orderBy("query", "priority").collect()
        return reports.table(["query", "family", "patch"], [(r.query, r.family, doctor.prescription(r).summary()) for r in rows]), True
    if c == "heal":
        done = doctor.run_repair(engine, queries, qrels, cache, doctor.LADDER if args.rules == "ladder" else doctor.SCRIPTED)
        if args.ledger:
            Path(args.ledger).write_text(files.ledger_json(files.ledger(spark, done.accepted)))
        return reports.repair_report(done), doctor.healthy_regressions(done, queries).isEmpty()
    if c == "treat":
        row, mine = None, queries.where(F.col("query") == args.query)
        if args.knowledge:
            row = treatment.contexts(engine, mine.select("query"), read_knowledge(spark, args.knowledge), cache).first()
        rules = doctor.LADDER if args.rules == "ladder" else doctor.SCRIPTED
        ask = treatment.RuleDoctor(args.query, treatment.candidates(engine, mine, cache, rules).get(args.query, []), args.rules == "ladder")
        done = treatment.treat(Executor(engine, queries, qrels, vectors=cache), ask, args.query, row.context if row else "", tuple(row.doc_ids) if row else ())
        return reports.treatment_report(done), done.healed
    if c == "demo-trap":
        verdicts = [evaluation.run_gate(engine, queries, qrels, Prescription.from_json(Path(p).read_text()))[0] for p in (args.good, args.broad)]
        return "\n\n".join(v.feedback() for v in verdicts), [v.accepted for v in verdicts] == [True, False]
    if c == "export-es":
        settings = search_server.render_settings(analyzer.config)
        if wrong := search_server.validate_settings(settings):
            return "\n".join(wrong), False
        if args.url:
            server = search_server.SearchServer.from_environment(args.url)
            server.recreate(args.index, settings)
            if engine is not None:
                search_server.write_documents(engine.docs, server, args.index)
        return json.dumps(settings, ensure_ascii=False, indent=2), True
    if c == "build-vectors":
        def embed():
            from sentence_transformers import SentenceTransformer

            return SentenceTransformer(args.model).encode

        files.save_vectors(files.build_vectors(engine.index.vocabulary().withColumnRenamed("term", "token"), embed), args.output, args.model)
        return f"vectors in {args.output}", True
    if c == "build-lake":
        lake.write_catalog(synthetic.synthesize_catalog(spark, args.docs), args.root)
        lake.write_query_log(synthetic.synthesize_query_log(spark, args.rows, ["후라이팬", "도너츠", "핸드폰"], ["프라이팬", "도넛", "물티슈", "백팩"], days=args.days), args.root)
        return reports.table(["table", "files", "bytes", "rows", "partitions"], [tuple(r) for r in lake.lake_stats(spark, args.root).collect()]), True
    if c == "mine-logs":
        found = mining.mine(lake.read_query_log(spark, args.root), args.engine, min_volume=args.min_volume, limit=args.limit, since=args.since, until=args.until)
        return reports.candidates_report(found), True
    if c == "scale-bench":
        good, broad = (Prescription.from_json(Path(p).read_text()) for p in (args.good, args.broad))
        points = scale.run_scale(spark, spark.read.parquet(args.docs), [int(n) for n in args.sizes.split(",")], queries, qrels, good, broad, args.probe, analyzer)
        return reports.scale_report(points), scale.verdict_holds(points)
    if c == "rag-eval":
        kb = read_knowledge(spark, args.knowledge)
        relevant, out = retrieval.relevant_docs(queries.where("family is not null"), kb), {}
        asked = queries.where("family is not null").select("query", analyzer.tokens("query").alias("tokens"))
        for size in [None if s == "none" else int(s) for s in args.chunking.split(",")]:
            if size is None:
                owners, docs = None, kb.select("doc_id", analyzer.tokens(F.concat_ws("\n", "title", "body")).alias("tokens"))
            else:
                owners = chunking.chunk_knowledge(kb, size, size // 5)
                docs = owners.select(F.col("chunk_id").alias("doc_id"), analyzer.tokens("display").alias("tokens"))
            for mode in retrieval.MODES:
                r = retrieval.Retriever(docs, mode, cache, owners)
                out[f"{mode}{' (no vectors)' * r.degraded}, chunks {size or 'none'}"] = retrieval.retrieval_means(retrieval.retrieval_metrics(r.retrieve(asked, args.k), relevant))
        known = vectors.coverage(docs.select(F.explode("tokens").alias("token")), cache).first().coverage if cache is not None else None
        return reports.retrieval_report(out, known), True
    if c == "baseline":
        measured = evaluation.evaluate(engine, queries, qrels)
        if args.action == "write":
            files.write_baseline(measured, args.file)
            return f"baseline in {args.file}", True
        base, epsilon = files.load_baseline(spark, args.file)
        diff = evaluation.compare(base, measured, epsilon).cache()
        verdict = evaluation.baseline_ok(diff).first()
        return reports.baseline_report(verdict, diff), verdict.ok
    if c == "vector-probe":
        pairs = spark.read.json(args.pairs, schema="a string, b string, link boolean")
        scored = vectors.score_pairs(pairs, cache)
        answers = vectors.rank_of_answer(pairs.where("link").select(F.col("a").alias("token"), F.col("b").alias("answer")), cache)
        return reports.probe_report(vectors.separability(scored).first(), scored, vectors.hub_scores(cache), answers), True
    if c == "es-verify":
        server = search_server.SearchServer.from_environment(args.url)
        hits = search_server.search_all(queries, server, args.index, index.TOP_K)
        remote = written(evaluation.metrics(queries, hits.select("query", "doc_id", "rank"), qrels), "remote")  # asked once
        diff = search_server.divergence(evaluation.evaluate(engine, queries, qrels), remote)
        return reports.divergence_report(diff, search_server.token_difference(queries, analyzer, analyzer)), diff.where("diverged").isEmpty()
    service = RepairService(engine, queries, qrels, store=PatchStore(spark, args.store) if args.store else None)
    if args.protocol == "lines":
        api.ToolProtocol(service).run()
    else:
        api.serve(service, port=args.port).serve_forever()
    return "", True


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    text, passed = run(args, session.local_session())
    if args.output and args.command != "build-vectors":
        Path(args.output).write_text(text)
    else:
        sys.stdout.write(text + "\n")
    if step := os.environ.get("GITHUB_STEP_SUMMARY"):
        with open(step, "a") as f:
            f.write(text + "\n")
    return 0 if passed else 1


if __name__ == "__main__":
    sys.exit(main())

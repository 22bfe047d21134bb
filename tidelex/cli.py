"""Command line: python -m tidelex.cli VERB ... over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import encode, sample, search, train, vocab
from .plans import retrievers
from .plans.base import Base
from .plans.registry import PAIRS, guard_test_split
from .sources import store

WIN_METRICS = ("ndcg10", "r100", "mrr10")
#: What a run has to be above, by pair.
WINS = {"eng-eng": ["bm25"], "spa-spa": ["bm25"], "eng-spa": ["translate-bm25"], "spa-eng": ["translate-bm25"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelex")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple[str, dict]) -> None:
        v = verbs.add_parser(name)
        v.add_argument("data", help="folder with documents, benchmark and embeddings tables")
        v.add_argument("out", help="where the result is written")
        for flag, kw in args:
            v.add_argument(flag, **kw)

    verb("vocab-build")
    verb("vocab-prune", ("--threshold", {"type": int, "default": 50}))
    verb("vocab-subset", ("--concepts", {"required": True, "help": "a:b, or a comma list of numbers or ids"}))
    verb("scan")
    verb("embed", ("--per-article", {"type": int, "default": 2}), ("--per-concept", {"type": int, "default": 100}))
    verb("encode", ("--query-lang", {"choices": ("en", "es"), "help": "encode the benchmark's items instead of the documents"}), ("--backbone-weight", {"type": float, "default": 1.0}))
    verb("train", ("--epochs", {"type": int, "default": 10}), ("--epoch-size", {"type": int, "default": 512}), ("--batch", {"type": int, "default": 0}), ("--run", {"default": "run"}))
    verb("export", ("--heads", {"required": True}), ("--report", {"help": "a report whose metrics go on the card"}))
    verb("index", ("--retriever", {"default": "bm25"}), ("--lang", {"choices": ("en", "es"), "default": "en"}), ("--rebuild", {"action": "store_true"}))
    verb("splits-build", ("--seed", {"type": int, "default": 42}), ("--dev", {"type": int, "default": 10}), ("--val", {"type": int, "default": 10}), ("--force", {"action": "store_true"}))
    verb("eval-run", ("--retriever", {"default": "bm25"}), ("--pairs", {"nargs": "+", "choices": tuple(PAIRS), "default": list(PAIRS)}), ("--split", {"default": "validation"}), ("--k", {"type": int, "default": 100}), ("--allow-test", {"action": "store_true"}), ("--baselines", {}))
    for name in ("baselines-lock", "baselines-check"):
        verb(name, ("--report", {"required": True, "help": "a report's JSON file"}), ("--split", {"default": "validation"}))
    return p


def encoded(b: Base, query_lang: str | None, weight: float):
    if query_lang:
        rows = b.query_tokens.withColumn("lang", F.lit(query_lang))
    else:
        rows = b.doc_tokens.join(b.docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    return encode.packed(encode.encode_sparse(rows, b.word_concept, bool(query_lang), weight).withColumnRenamed("value", "weight"))


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    b = Base(spark, a.data)
    if a.verb == "vocab-build":
        b.vocab.write.parquet(a.out)
        b.word_concept.write.mode("overwrite").json(f"{a.out}_lookup")
    elif a.verb == "vocab-prune":
        store.replace_with_backup(vocab.prune(b.vocab, b.counts, a.threshold), a.out)
    elif a.verb == "vocab-subset":
        vocab.chosen(b.vocab, a.concepts).write.parquet(a.out)
    elif a.verb == "scan":
        b.counts.write.parquet(a.out)
    elif a.verb == "embed":
        rows, seen = sample.counted(sample.points(sample.capped_articles(b.arts, b.word_concept, a.per_article, a.per_concept)), "rows")
        store.upsert(spark, a.out, rows, 1)
        print(f"{seen.get['rows']} rows stored")
    elif a.verb == "encode":
        encoded(b, a.query_lang, a.backbone_weight).write.parquet(a.out)
    elif a.verb == "train":
        known = store.read_or_none(spark, a.out)
        rows = b.vec if known is None else store.untrained(b.vec, known)
        store.save_heads(a.out, train.train_heads(rows, train.Training(epochs=a.epochs, epoch_size=a.epoch_size)), a.run, a.batch)
    elif a.verb == "export":
        report = json.loads(store.Files(a.report).read(a.report)) if a.report else {"results": {}}
        rows = [{"pair": p, "metric": m, "value": v} for p, ms in report["results"].items() for m, v in ms.items()]
        store.export_model(a.out, b.vocab, store.merged_heads(spark, a.heads), {"outputs": 8, "index_base": 8}, "# Concept heads\n", rows)
    elif a.verb == "index":
        print(retrievers.retrievers.get(a.retriever).index(b, a.out, a.retriever, a.lang, a.rebuild))
    elif a.verb == "splits-build":
        ids = search.hash_split(b.table("benchmark").selectExpr("item_id AS qid", "'all' AS pair"), a.dev, a.val, str(a.seed)).orderBy("split", "ord").collect()
        names = sorted({r["split"] for r in ids})
        store.write_splits(a.out, {n: [str(r["qid"]) for r in ids if r["split"] == n] for n in names}, a.seed, a.force)
    elif a.verb == "eval-run":
        try:
            guard_test_split(a.split, a.allow_test)
        except PermissionError as e:
            print(e, file=sys.stderr)
            return 2
        q = search.hash_split(b.table("benchmark").selectExpr("item_id AS qid", "'all' AS pair"), 10, 10, "42").where(f"split = '{a.split}'").select("qid")
        got = {r["pair"]: r for r in retrievers.evaluate(b, (a.retriever,), tuple(a.pairs), a.k, only=q).collect()}
        results = {p: {m: r[f"{m}_mean"] for m in WIN_METRICS} for p, r in sorted(got.items())}
        locked = {n: {p: {m: v["value"] for m, v in x.get(a.split, {}).items()} for p, x in ps.items()} for n, ps in store.baselines(a.baselines).items()} if a.baselines else None
        print(store.write_report(a.out, a.retriever, store.revision()[0], results, locked))
        if a.split == "test":
            for pair in a.pairs:  # looked at, whether or not it has queries
                store.audit(f"{a.out}/audit.tsv", a.retriever, pair, "test")
    elif a.verb in ("baselines-lock", "baselines-check"):
        report = json.loads(store.Files(a.report).read(a.report))
        if a.verb == "baselines-check":
            bad = store.check_baselines(a.out, report["results"], WINS, a.split)
            print("\n".join(bad or ["all pairs hold"]), file=sys.stderr if bad else sys.stdout)
            return 1 if bad else 0
        sha, dirty = store.revision()
        try:
            for pair, ms in report["results"].items():
                for metric, value in ms.items():
                    store.lock_baseline(a.out, report["retriever"], pair, a.split, metric, value, a.report, sha, dirty, report["git_sha"])
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Stores of points and postings as Parquet, with the rules on reuse, replacement and resumption."""

from __future__ import annotations

import datetime
import hashlib
import json
import pathlib
import subprocess
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share; a temporary one only where the session names none and runs on this machine alone."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelex-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


class Files:
    """Small files by Hadoop paths, so that what is written beside Spark's tables is in the same store."""

    def __init__(self, path: str):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        jvm = spark.sparkContext._jvm
        self.of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if hasattr(self.fs, "getRawFileSystem") and self.fs.getScheme() == "file":  # its checksum files would go stale when a file is edited by hand
            self.fs = self.fs.getRawFileSystem()
        self.io = jvm.org.apache.commons.io.IOUtils

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.of(path))

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self.of(path))
        try:
            return bytes(self.io.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        stream = self.fs.create(self.of(path), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.of(old), self.of(new)):
            raise OSError(f"{old} can't be renamed to {new}")


def listing(spark: SparkSession, path: str) -> str:
    """A digest of the files under path: their names, sizes and times."""
    files = Files(path)
    found, each = [], files.fs.listFiles(files.of(path), True)
    while each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


class CorpusChanged(ValueError):
    """An index exists for another corpus."""


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


class Index:
    """Postings by language under a folder, with the digest of the corpus they are of."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def build(self, name: str, digest: str, n_docs: int, make: Callable[[], DataFrame], rebuild: bool = False) -> str:
        """reused, built or replaced; raises CorpusChanged if the index is of another corpus and rebuild isn't set. An index
        without a digest is replaced."""
        at = f"{self.root}/{name}"
        meta = read_or_none(self.spark, f"{at}/meta")
        there = meta.first() if meta is not None else None
        if there is not None and not rebuild:
            if there["digest"] != digest:
                raise CorpusChanged(f"{name}: indexed corpus {there['digest'][:12]}, given {digest[:12]}")
            return "reused"
        postings = make()
        # By ranges, which a sample of the terms balances: a term with very many rows spreads over several files by id.
        postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{at}/postings")
        self.spark.createDataFrame([(digest, n_docs)], "digest string, n_docs long").write.mode("overwrite").parquet(f"{at}/meta")
        return "replaced" if there is not None else "built"

    def size(self, name: str) -> int:
        return self.spark.read.parquet(f"{self.root}/{name}/meta").first()["n_docs"]

    def postings(self, name: str) -> DataFrame:
        df = read_or_none(self.spark, f"{self.root}/{name}/postings")
        if df is None:
            raise RuntimeError(f"{name} isn't indexed")
        return df


class Collection:
    """Points with vectors under a folder, of a fixed dimension."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, dim: int | None, recreate: bool = False) -> str:
        """created, recreated, or kept if it is there already; raises without a dimension or where another one is kept."""
        if not dim or dim < 1:
            raise ValueError("the vectors' dimension isn't known")
        meta = read_or_none(self.spark, f"{self.path}/meta")
        there = meta.first() if meta is not None else None
        if there is not None and not recreate:
            if there["dim"] != dim:
                raise ValueError(f"{self.path} holds vectors of {there['dim']} places, not {dim}")
            return "kept"
        if there is not None:
            files = Files(self.path)
            files.fs.delete(files.of(self.path), True)
        self.spark.createDataFrame([(dim,)], "dim int").write.mode("overwrite").parquet(f"{self.path}/meta")
        return "created" if there is None else "recreated"

    def add(self, rows: DataFrame, version: int) -> None:
        """rows(id, x, ...); raises if a vector has another dimension."""
        dim = self.spark.read.parquet(f"{self.path}/meta").first()["dim"]
        if bad := rows.where(F.size("x") != dim).select("id").first():
            raise ValueError(f"the vector of {bad['id']} hasn't {dim} places")
        upsert(self.spark, f"{self.path}/points", rows, version)

    def points(self) -> DataFrame:
        return current(self.spark, f"{self.path}/points")


def replace_with_backup(df: DataFrame, path: str) -> str:
    """Writes df to path; what was there first is kept under path_full, once: later calls never replace that. The old table is renamed away
    before the new one takes its place, and deleted only then: after a crash between, it lies at path_old, from where the next call brings it back."""
    files, full = Files(path), f"{path}_full"
    fresh, old = f"{path}_new", f"{path}_old"
    if files.exists(old) and not files.exists(path):
        files.rename(old, path)
    df.write.mode("overwrite").parquet(fresh)  # df may come from path itself
    if files.exists(path):
        files.fs.delete(files.of(old), True)
        files.rename(path, old if files.exists(full) else full)
    files.rename(fresh, path)
    files.fs.delete(files.of(old), True)
    return full


def tsv_cache(spark: SparkSession, path: str, make: Callable[[], DataFrame], schema: str) -> DataFrame:
    """A tab-separated copy of what make gives, made once."""
    if not Files(path).exists(f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").csv(path)
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def frozen(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """An epoch's samples, drawn once and replayed from then on."""
    if not Files(path).exists(f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, version: int) -> None:
    """Appends rows(id, ...) as a version; a version that is written again replaces itself, so replays are safe."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each id."""
    df = spark.read.option("basePath", path).parquet(path)
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version")))).where("rn = 1").drop("rn")


def save_heads(path: str, heads: DataFrame, run: str, batch: int) -> None:
    """Appends a batch of trained heads; names carry the run, so a resumed run never overwrites an earlier one's."""
    heads.withColumns({"run": F.lit(run), "batch": F.lit(batch)}).write.mode("append").parquet(path)


def merged_heads(spark: SparkSession, path: str) -> DataFrame:
    """The latest head of each concept."""
    w = Window.partitionBy("concept_id").orderBy(F.desc("run"), F.desc("batch"))
    return spark.read.parquet(path).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "run", "batch")


def load_heads(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """(pos, concept_id, weights) of a published folder (heads in the order of config.json's concept_ids) or, where it holds none, of a training run's heads under
    concept_models, in the order of ids. A path overrides both: one that ends in /heads is a published table, which needs config.json beside it."""
    from ..operators.order import numbered  # which builds on this module

    at = path or (f"{folder}/heads" if Files(folder).exists(f"{folder}/heads") else f"{folder}/concept_models")
    if not at.rstrip("/").endswith("/heads"):
        heads = merged_heads(spark, at)
        return numbered(heads.select("concept_id", "weights"), [F.col("concept_id")], "pos").select((F.col("pos") - 1).alias("pos"), "concept_id", "weights")
    config = f"{at.rstrip('/').removesuffix('/heads')}/config.json"
    if not Files(config).exists(config):
        raise FileNotFoundError(f"{at} needs config.json beside it, whose concept_ids give the order")
    ids = json.loads(Files(config).read(config))["concept_ids"]
    order = spark.createDataFrame(list(enumerate(ids)), "pos long, concept_id string")
    return order.join(spark.read.parquet(at), "concept_id").select("pos", "concept_id", "weights")


def untrained(concepts: DataFrame, heads: DataFrame) -> DataFrame:
    return concepts.join(heads.select("concept_id"), "concept_id", "left_anti")


def recipe_key(**fields: object) -> str:
    """The cache key of a recipe: SHA-1 over its sorted fields, the vocabulary's digest among them."""
    return hashlib.sha1(json.dumps(fields, sort_keys=True, default=str).encode()).hexdigest()


def content_key(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: their number and the sum of their hashes."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{r[0]}:{r[1]}"


def cached(spark: SparkSession, root: str, make: Callable[[], DataFrame], **fields: object) -> DataFrame:
    """What make gives, written once for a recipe and read from then on; what a broken run has left is made anew."""
    at = f"{root}/{recipe_key(**fields)}"
    if not Files(root).exists(f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_splits(folder: str, splits: dict[str, list[str]], seed: int, force: bool = False) -> dict:
    """A compact JSON file a split, and a manifest with their digests; refuses to overwrite unless forced."""
    store, manifest = Files(folder), f"{folder}/manifest.json"
    if store.exists(manifest) and not force:
        raise FileExistsError(manifest)
    files = {}
    for name, ids in splits.items():
        raw = json.dumps(ids, separators=(",", ":")).encode()
        store.write(f"{folder}/{name}.json", raw)
        files[f"{name}.json"] = {"sha256": hashlib.sha256(raw).hexdigest(), "n": len(ids)}
    out = {"seed": seed, "files": files}
    store.write(manifest, json.dumps(out, indent=1).encode())
    return out


def missing_translations(texts: DataFrame, cache: DataFrame, model: str, src: str, tgt: str) -> DataFrame:
    """texts(text) that the cache (model, src, tgt, key, translation) doesn't hold, once each, with their content key."""
    keyed = texts.select("text", F.sha2("text", 256).alias("key")).dropDuplicates(["key"])
    return keyed.join(cache.where((F.col("model") == model) & (F.col("src") == src) & (F.col("tgt") == tgt)), "key", "left_anti")


def export_model(folder: str, vocab: DataFrame, heads: DataFrame, config: dict, card: str, metrics: list[dict] | None = None) -> None:
    """A publishable folder: vocabulary and heads as Parquet, configuration as JSON, the module that applies heads, and a card with metric rows.
    Vectors and local paths stay out."""
    vocab.write.mode("errorifexists").parquet(f"{folder}/vocabulary")
    heads.select("concept_id", "weights").write.mode("errorifexists").parquet(f"{folder}/heads")
    files = Files(folder)
    config = {"concept_ids": [r[0] for r in heads.select("concept_id").orderBy("concept_id").collect()]} | config
    files.write(f"{folder}/config.json", json.dumps(config, indent=1, sort_keys=True).encode())
    files.write(f"{folder}/vector.py", pathlib.Path(vector.__file__).read_bytes())
    rows = [f"| {m['pair']} | {m['metric']} | {m['value']:.4f} | {m.get('comparator') or ''} | {'' if m.get('bar') is None else format(m['bar'], '.4f')} |" for m in metrics or []]
    table = ["", "| pair | metric | value | beside | its value |", "|---|---|---|---|---|", *rows, ""] if rows else []
    files.write(f"{folder}/README.md", (card + "\n".join(table)).encode())


def stamp() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H%M%SZ")


def revision(folder: str = ".") -> tuple[str, bool]:
    """(commit, whether files differ from it); ("unknown", True) outside a checkout."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True)
    got = git("rev-parse", "HEAD")
    return (got.stdout.strip(), bool(git("status", "--porcelain").stdout.strip())) if got.returncode == 0 else ("unknown", True)


def write_report(folder: str, name: str, sha: str, results: dict, baselines: dict | None = None) -> str:
    """JSON and Markdown under <time>__<name>__<sha7>, with the difference from each baseline {name: {pair: {metric: value}}}; returns the path
    without suffix."""
    at, files = f"{folder}/{stamp()}__{name}__{sha[:7]}", Files(folder)
    files.write(f"{at}.json", json.dumps({"retriever": name, "git_sha": sha, "results": results}, indent=1).encode())
    head = ["pair", "metric", "value", *(f"against {b}" for b in baselines or {})]
    rows = []
    for pair, ms in results.items():
        for metric, value in ms.items():
            bars = [(b.get(pair) or {}).get(metric) for b in (baselines or {}).values()]
            rows.append("| " + " | ".join([pair, metric, f"{value:.4f}", *("" if x is None else f"{value - x:+.4f}" for x in bars)]) + " |")
    files.write(f"{at}.md", "\n".join([f"# {name}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *rows, ""]).encode())
    return at


def baselines(path: str) -> dict:
    files = Files(path)
    return json.loads(files.read(path)) if files.exists(path) else {}


def lock_baseline(path: str, name: str, pair: str, split: str, metric: str, value: float, report: str, sha: str, dirty: bool, report_sha: str | None = None) -> None:
    """Records a baseline value; a dirty tree is refused, and a report of another commit."""
    if dirty:
        raise ValueError("the tree has changes that aren't committed")
    if report_sha is not None and report_sha != sha:
        raise ValueError(f"the report is of {report_sha[:7]}, not of {sha[:7]}")
    data = baselines(path)
    data.setdefault(name, {}).setdefault(pair, {}).setdefault(split, {})[metric] = {"value": value, "report_path": report, "git_sha": sha}
    Files(path).write(path, json.dumps(data, indent=1, sort_keys=True).encode())


def check_baselines(path: str, results: dict, wins: dict[str, list[str]], split: str, metric: str = "mrr10") -> list[str]:
    """What doesn't hold of results {pair: {metric: value}}: each pair has to be above the locked values of the names in wins; a value
    that isn't locked passes."""
    data, out = baselines(path), []
    for pair, names in wins.items():
        for name in names:
            bar = data.get(name, {}).get(pair, {}).get(split, {}).get(metric, {}).get("value")
            got = results.get(pair, {}).get(metric)
            if bar is not None and got is not None and not got > bar:
                out.append(f"{pair}: {metric} {got:.4f} isn't above {name}'s {bar:.4f}")
    return out


def audit(path: str, *fields: str) -> None:
    """Appends a stamped line."""
    files = Files(path)
    before = files.read(path) if files.exists(path) else b""
    files.write(path, before + ("\t".join([stamp(), *fields]) + "\n").encode())


def translate(spark: SparkSession, path: str, texts: DataFrame, model: str, src: str, tgt: str, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """texts(text) -> (text, translation): what the cache under path lacks goes to the provider, (key, text) -> (key, translation), as one
    batch, and is added to the cache."""
    schema = "model string, src string, tgt string, key string, translation string"
    cache = read_or_none(spark, path)
    misses = missing_translations(texts, spark.createDataFrame([], schema) if cache is None else cache, model, src, tgt)
    if not misses.isEmpty():
        new = provider(misses.select("key", "text")).select(F.lit(model).alias("model"), F.lit(src).alias("src"), F.lit(tgt).alias("tgt"), "key", "translation")
        new.write.mode("append").parquet(path)
    got = spark.read.schema(schema).parquet(path).where((F.col("model") == model) & (F.col("src") == src) & (F.col("tgt") == tgt)).select("key", "translation")
    return texts.select("text", F.sha2("text", 256).alias("key")).join(got, "key").select("text", "translation")

import json
import os

import pytest

from oracle import DATA
from tidelex.cli import main
from tidelex.plans.base import Base
from tidelex.plans.registry import retrievers


def test_verbs(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    assert main(["vocab-build", DATA, at("vocab")], spark) == 0 and spark.read.parquet(at("vocab")).count() > 100
    assert main(["vocab-subset", DATA, at("some"), "--concepts", "3,C-00005"], spark) == 0 and spark.read.parquet(at("some")).count() == 2
    for _ in range(2):  # the second call finds all heads trained
        assert main(["train", DATA, at("heads"), "--epochs", "1"], spark) == 0
    assert spark.read.parquet(at("heads")).count() == 10
    assert main(["export", DATA, at("model"), "--heads", at("heads")], spark) == 0 and os.path.exists(at("model/config.json"))
    assert main(["encode", DATA, at("queries"), "--query-lang", "es"], spark) == 0 and spark.read.parquet(at("queries")).count() > 10
    assert [main(["index", DATA, at("index")], spark) for _ in range(2)] == [0, 0]
    found = retrievers.get("bm25").search(Base(spark, DATA), at("index"), "bm25", "en", "en", 5)
    assert 0 < found.count() <= 5 * 50 and found.agg({"rank": "max"}).first()[0] == 5
    with pytest.raises(RuntimeError, match="isn't indexed"):
        retrievers.get("bm25").search(Base(spark, DATA), at("index"), "bm25", "es", "es")
    for k in (1, 2):  # what the first call replaces is kept
        assert main(["vocab-prune", DATA, at("vocab"), "--threshold", str(10 * k)], spark) == 0
    assert spark.read.parquet(at("vocab_full")).count() > spark.read.parquet(at("vocab")).count()
    assert main(["splits-build", DATA, at("splits")], spark) == 0 and len(json.load(open(at("splits/dev.json")))) == 10


def test_test_split_is_sealed(spark, tmp_path):
    assert main(["eval-run", DATA, str(tmp_path / "r"), "--split", "test"], spark) == 2
    assert main(["eval-run", DATA, str(tmp_path / "r"), "--split", "test", "--allow-test"], spark) == 0
    assert (tmp_path / "r" / "audit.tsv").read_text().count("test") == 4
    report = next(str(x) for x in (tmp_path / "r").glob("*.json"))
    pair = sorted(json.load(open(report))["results"])[-1]  # pairs without a relevant document have no result
    assert pair in ("eng-eng", "spa-spa")
    bars = tmp_path / "bars.json"
    assert main(["baselines-check", DATA, str(bars), "--report", report, "--split", "test"], spark) == 0
    bars.write_text(json.dumps({"bm25": {pair: {"test": {"mrr10": {"value": 2.0}}}}}))
    assert main(["baselines-check", DATA, str(bars), "--report", report, "--split", "test"], spark) == 1
    with pytest.raises(SystemExit):
        main(["unknown"], spark)

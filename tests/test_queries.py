"""Every query with SQL gives the SQL's rows; the others run and keep their invariants."""

import pytest

import oracle
from oracle import DATA
from tidelex.plans import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    oracle.check(con, catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name])


def test_training_lowers_the_loss(spark):
    t = catalog.queries()["train_heads"](spark, DATA).toPandas()
    assert len(t) and (t.last_loss < t.first_loss).mean() > 0.8


def test_kmeans(spark):
    k = catalog.queries()["kmeans_best_k"](spark, DATA).toPandas()
    assert k.k.between(2, 5).all() and (k.silhouette > -1).all()


def test_schedules_and_vectors(spark):
    run = lambda q: catalog.queries()[q](spark, DATA).toPandas()
    s = run("schedule_verdict")
    assert set(s.name) == {"linear", "exponential"} and (s.wins + s.ties + s.losses == 1).all() and (s.undivided == 0).all()
    assert (run("sentence_vectors").squared.sub(1).abs() < 1e-3).all()
    v = run("concept_vectors")
    # Of length 1, but for words whose few trigrams cancel out in the stand-in's places.
    assert len(v) and (v.length.between(0.999, 1.001) | (v.length == 0)).all() and (v.length > 0).mean() > 0.99 and not v.duplicated(["id", "concept_id"]).any()


def test_coupled_rows(spark):
    rows = catalog.queries()["coupled_fetch"](spark, DATA).toPandas()
    assert not rows.duplicated(["lang", "doc_id", "sent_ord"]).any() and rows.groupby("concept_id").size().max() <= 10 and rows.groupby(["word", "lang"]).size().max() <= 4


def test_vocabulary_grows_with_the_data(spark):
    """No fixed slice of the words: a table with more of them has a larger graph."""
    n = [catalog.queries()["edge_weights"](spark, d).count() for d in (DATA, DATA.replace("0.001", "0.01"))]
    assert n[0] > 2000 and n[1] > 1.5 * n[0]


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0

"""Evaluations shuffle ratings once by user, and read no statistics where their ranker has none."""

from lumengrid.plans import catalog, evaluate
from lumengrid.sources import store, tables

SF = "/root/testdata/sf0.001"


def _plan(capsys, df):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_ratings_of_a_user_are_dealt_once(spark, capsys):
    plain, dealt = (evaluate.temporal_split(tables.ratings(spark, SF, by_user=x)) for x in (False, True))
    count = lambda df: _plan(capsys, df).count("Exchange hashpartitioning(user_id")
    assert (count(plain), count(dealt)) == (2, 1)
    assert sorted(plain.collect()) == sorted(dealt.collect())


def test_vectors_are_the_catalogs_without_a_pass_over_ratings(spark, capsys):
    found = catalog.vectors(spark, SF)
    whole = catalog.catalog(spark, SF).select("item_id", "embedding", "factor")
    assert sorted(found.collect(), key=lambda r: r.item_id) == sorted(whole.collect(), key=lambda r: r.item_id)
    assert "o_orderkey" not in _plan(capsys, found) and "o_orderkey" in _plan(capsys, whole)


def test_trained_evaluation_leaves_no_tables_of_factors(spark, monkeypatch):
    made, gone = [], []
    kept, drop = store.kept, store.drop
    monkeypatch.setattr(store, "kept", lambda *a: made.append(kept(*a)) or made[-1])
    monkeypatch.setattr(store, "drop", lambda *frames: gone.extend(f.kept_path for f in frames) or drop(*frames))
    ratings = tables.ratings(spark, SF)
    evaluate.evaluate_trained(ratings, catalog.vectors(spark, SF), users_limit=20, rank=2).collect()
    factors = [f.kept_path for f in made if f.columns[1:] == ["features"]]
    assert len(factors) == 2 and set(factors) <= set(gone)

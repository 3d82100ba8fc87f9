"""The settings that the queries of boosted trees fit with."""

from ratewise.operators import boosting
from ratewise.plans import learned

DATA = "/root/testdata/sf0.001"


def fitted_with(spark, monkeypatch, query):
    """The settings of a query's fit, which is left out."""
    asked = []

    def noted(df, features, *a, settings=None, **b):
        asked.append(settings)
        return boosting.Boosted(features, 0.0, [], [])

    monkeypatch.setattr(boosting, "fit", noted)
    query(spark, DATA)
    return asked


def test_depth_wise_trees_have_all_rounds_of_the_baseline(spark, monkeypatch):
    assert fitted_with(spark, monkeypatch, learned.j5_depth_wise) == [boosting.DEPTH_WISE]


def test_leaf_wise_trees_have_all_rounds_of_the_baseline(spark, monkeypatch):
    assert fitted_with(spark, monkeypatch, learned.j5_leaf_wise) == [boosting.LEAF_WISE]


def test_explained_trees_have_all_rounds_of_the_baseline(spark, monkeypatch):
    assert fitted_with(spark, monkeypatch, learned.n1_tree_contributions) == [boosting.LEAF_WISE]

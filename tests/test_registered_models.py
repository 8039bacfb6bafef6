"""Model queries are registered with the operators' own defaults."""

import inspect

import pytest

from prepline.operators import models
from prepline.queries import queries


class Called(Exception):
    pass


@pytest.mark.parametrize("query, operator, set_", [
    ("append_classif_score", "_fit", {"df", "target", "features"}), ("append_regression", "_fit_regression", {"df", "target", "features"}), ("permutation_importance", "permutation_importance", {"df", "target"}),
    ("ebfs", "ebfs", {"df", "target"}), ("suggest_hyperparams", "suggest_hyperparams", {"df", "target", "features"}),
])
def test_defaults(spark, small, monkeypatch, query, operator, set_):
    signature = inspect.signature(getattr(models, operator))

    def spy(*args, **kwargs):
        raise Called(signature.bind(*args, **kwargs).arguments)

    monkeypatch.setattr(models, operator, spy)
    with pytest.raises(Called) as e:
        queries()[query](spark, small)
    given = e.value.args[0]
    assert set(given) == set_
    assert query != "ebfs" or len(given["df"].columns) == 5  # four features, so that there are several triples

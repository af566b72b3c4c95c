import pytest

import catalog.model_queries as Q
from catalog.base import QUERIES
from paperloom.operators.ml import supervised


@pytest.mark.parametrize("name", ["boosted_regression", "boosted_classification", "forest_regression", "forest_classification"])
def test_registered_models_search_the_whole_grid(monkeypatch, name):
    seen = {}

    class Fitted:
        metrics = None

    def fit(rows, id_col, target, module, model, features, grid=None):
        seen["points"] = len(supervised.expand_grid(grid if grid is not None else supervised.GRIDS[module, model]))
        return Fitted

    monkeypatch.setattr(Q, "fit_supervised", fit)
    monkeypatch.setattr(Q, "_orders", lambda spark, sf: None)
    QUERIES[name](None, "")
    assert seen["points"] == (27 if name.startswith("boosted") else 6)

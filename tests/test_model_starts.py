"""The stored model is fitted with the operator's own number of starts."""

import inspect

import pytest

from arcloom.operators.clustering import STARTS
from arcloom.operators.song_model import fit_song_model
from arcloom.plans import catalogue_queries as Q


def test_model_save_load_takes_all_starts(spark, monkeypatch):
    seen = []

    def fit(*args, **settings):
        call = inspect.signature(fit_song_model).bind(*args, **settings)
        call.apply_defaults()
        seen.append(call.arguments["n_init"])
        raise InterruptedError

    monkeypatch.setattr(Q, "fit_song_model", fit)
    with pytest.raises(InterruptedError):
        Q.model_save_load(spark, "/root/testdata/sf0.001")
    assert seen == [STARTS]

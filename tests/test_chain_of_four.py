"""The least-squares chain over all four variables of the panel against numpy, row by row."""

import os

import numpy as np
import pytest

from stationfill.catalog.fill_queries import masked_wide
from stationfill.catalog.views import VARIABLES, Views
from stationfill.operators import chained

from tests.test_fit_and_score import chain_by_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")
def test_ten_rounds_on_the_panel(spark):
    wide = masked_wide(Views(spark, DATA)).cache()
    rows = wide.orderBy("station_id", "t").collect()
    x = np.array([[np.nan if r[c] is None else r[c] for c in VARIABLES] for r in rows], float)
    assert np.isnan(x).any(axis=0).all()
    model = chained.fit_chained(wide, VARIABLES, rounds=10, predictor="linear", tolerance=0)
    done = chained.impute_chained(wide, model).orderBy("station_id", "t").collect()
    got = np.array([[r[c] for c in VARIABLES] for r in done], float)
    centre, spread = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    want = chain_by_rows((x - centre) / spread, 10) * spread + centre
    assert got == pytest.approx(want, rel=1e-6)

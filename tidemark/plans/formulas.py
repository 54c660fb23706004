"""Alpha formulas over the daily panel, a few to a query."""

from __future__ import annotations

from functools import partial

from tidemark.functions import alphas, panel
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import DAILY


def _register(names: list[str]) -> None:
    @query(f"al_{names[0]}_to_{names[-1][5:]}", f"WITH {DAILY}, {alphas.as_sql(names, 'daily', ties=True)}")
    def _(spark, d):
        return panel.computed(partial(views.daily, spark, d), names, ties=True)


_names = list(alphas.FORMULAS)
for _k in range(0, len(_names), 8):
    _register(_names[_k : _k + 8])

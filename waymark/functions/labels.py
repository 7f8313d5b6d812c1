"""Label algebra over the three route scores, as Column expressions.

Names: a score triple has columns ``score_dense_only``, ``score_pure_rrf`` and ``score_sparse_only``.
NaN scores count as missing. Routes have three orders, which differ on purpose: the order of columns settles an arg-max,
the order of cost settles what is served, and combiners have their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routes in their orders, tolerances and margins.
ROUTES = ("dense_only", "pure_rrf", "sparse_only")
BY_COST = ("sparse_only", "dense_only", "pure_rrf")
COMBINER_ROUTES = ("dense_only", "sparse_only", "pure_rrf")
TIE_TOLERANCE = 1e-9
HIT_WEIGHT, NDCG_WEIGHT = 0.7, 0.3
DECISIVE_MARGIN = HIT_WEIGHT - NDCG_WEIGHT  # 0.39999999999999997 in doubles
RUNG_B_MARGIN = 0.4
CLASS_MARGIN = 0.1
GENUINE_TIE_DEPTH = 2
CEILING = 0.999
CLASS_OF = {"dense_only": "dense", "sparse_only": "sparse", "pure_rrf": "hybrid"}


def d(x: float) -> Column:
    return F.lit(float(x))


def score(route: str, suffix: str = "") -> Column:
    """A route's score; NaN is missing."""
    return F.nanvl(F.col(f"score_{route}{suffix}"), F.lit(None).cast("double"))


def scores(suffix: str = "", routes: Sequence[str] = ROUTES) -> list[Column]:
    return [score(r, suffix) for r in routes]


def top(suffix: str = "") -> Column:
    return F.greatest(*scores(suffix))


def low(suffix: str = "") -> Column:
    return F.least(*scores(suffix))


def runner_up(suffix: str = "") -> Column:
    return F.element_at(F.sort_array(F.array(*scores(suffix)), asc=False), 2)


def margin(suffix: str = "") -> Column:
    return top(suffix) - runner_up(suffix)


def first_route(condition, routes: Sequence[str], otherwise: Column | None = None) -> Column:
    """The first route that fulfils ``condition(route)``."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for r in reversed(routes):
        out = F.when(condition(r), F.lit(r)).otherwise(out)
    return out


def argmax(suffix: str = "", routes: Sequence[str] = ROUTES) -> Column:
    return first_route(lambda r: score(r, suffix) == top(suffix), routes)


def outcome_shape(suffix: str = "", tol: float = TIE_TOLERANCE) -> Column:
    return F.when(top(suffix) <= d(tol), "all_zero").when(top(suffix) - low(suffix) <= d(tol), "all_tied").otherwise("routes_differ")


def derive_route(suffix: str = "", tol: float = TIE_TOLERANCE) -> Column:
    """The cheapest route within ``tol`` of the best."""
    return first_route(lambda r: top(suffix) - score(r, suffix) <= d(tol), BY_COST)


def route_label(suffix: str = "", tol: float = TIE_TOLERANCE) -> Column:
    return F.when(outcome_shape(suffix, tol) != "all_zero", derive_route(suffix, tol))


def acceptable(route: str, tol: float = NDCG_WEIGHT, suffix: str = "") -> Column:
    """Whether the route is within ``tol`` of the best; null where nothing was found."""
    return F.when(top(suffix) > d(TIE_TOLERANCE), score(route, suffix) >= top(suffix) - d(max(tol, TIE_TOLERANCE)))


def serve(tol: float = NDCG_WEIGHT, suffix: str = "") -> Column:
    """The cheapest acceptable route; null where nothing was found."""
    return F.when(top(suffix) > d(TIE_TOLERANCE), first_route(lambda r: acceptable(r, tol, suffix), BY_COST))


def route_class(route: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CLASS_OF.items() for x in pair])[route]


def class_kind(depth: Column, class_margin: float = CLASS_MARGIN, tie_depth: int = GENUINE_TIE_DEPTH, suffix: str = "") -> Column:
    """decisive, undecisive, genuine_tie, fake_tie or all_zero."""
    shape = outcome_shape(suffix)
    return (
        F.when(shape == "all_zero", "all_zero")
        .when(shape == "all_tied", F.when(depth >= tie_depth, "genuine_tie").otherwise("fake_tie"))
        .when(margin(suffix) >= d(class_margin), "decisive")
        .otherwise("undecisive")
    )


def class_of_kind(kind: Column, suffix: str = "") -> Column:
    """A decisive row has its winner's class, a genuine tie is hybrid, all else has none."""
    return F.when(kind == "decisive", route_class(argmax(suffix))).when(kind == "genuine_tie", "hybrid").otherwise("")


def regime(suffix: str = "", class_margin: float = CLASS_MARGIN) -> Column:
    shape = outcome_shape(suffix)
    return F.when(shape != "routes_differ", shape).when(margin(suffix) < d(class_margin), "low_margin").otherwise("decisive_strong")


def stack_flag(a: str, b: str) -> Column:
    """Whether two stacks' winners agree: uncertifiable where either has none."""
    w1, w2 = unique_winner(scores(a, COMBINER_ROUTES)), unique_winner(scores(b, COMBINER_ROUTES))
    return F.when(w1.isNull() | w2.isNull(), "uncertifiable").when(w1 == w2, "stack_robust").otherwise("stack_specific")


def unique_winner(values: Sequence[Column], routes: Sequence[str] = COMBINER_ROUTES, tol: float = TIE_TOLERANCE) -> Column:
    """The route strictly ahead of all others by more than ``tol``; null on ties and on zeros."""
    ranked = F.sort_array(F.array(*values), asc=False)
    best, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    name = reduce(lambda out, rv: F.when(rv[1] == best, F.lit(rv[0])).otherwise(out), reversed(list(zip(routes, values, strict=True))), F.lit(None).cast("string"))
    return F.when((best > d(tol)) & (best - second > d(tol)), name)


def combined(alpha: Column, beta: Column, suffixes: dict[str, str], routes: Sequence[str] = COMBINER_ROUTES) -> list[Column]:
    """max(l1, l2) + alpha * llm_a + beta * r1 of every route; ``suffixes`` names the columns of the four sources."""
    return [F.greatest(score(r, suffixes["l1"]), score(r, suffixes["l2"])) + alpha * score(r, suffixes["llm_a"]) + beta * score(r, suffixes["r1"]) for r in routes]


def trust(alpha: Column, beta: Column, suffixes: dict[str, str]) -> Column:
    """The smallest set of sources that already picks the final winner."""
    final = unique_winner(combined(alpha, beta, suffixes))
    measured = unique_winner(combined(d(0), d(0), suffixes))
    assisted = unique_winner(combined(d(0), beta, suffixes))
    return F.when(final.isNull(), "ungrounded").when(measured == final, "measurement").when(assisted == final, "r1_assisted").otherwise("llm_a_only")

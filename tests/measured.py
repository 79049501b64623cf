"""Rows that the steps of a query gave, as Spark counted them."""


def _steps(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _steps(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _steps(plan.plan())
    found, children = [plan], plan.children()
    for i in range(children.size()):
        found += _steps(children.apply(i))
    return found


def most_rows(df):
    """Collect ``df``: its rows, and the most rows that one of its steps gave."""
    rows = df.collect()
    counts = [s.metrics().get("numOutputRows") for s in _steps(df._jdf.queryExecution().executedPlan())]
    return rows, max(c.get().value() for c in counts if c.isDefined())

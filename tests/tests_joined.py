"""What an executed frame's joins gave."""


def joined_rows(df):
    """The most rows that a join of an executed frame gave."""

    def walk(node):
        inner = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan() if "QueryStage" in node.getClass().getSimpleName() else None
        children = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().apply("numOutputRows").value()] if "Join" in node.getClass().getSimpleName() else []
        return max([*own, *map(walk, children)], default=0)

    return walk(df._jdf.queryExecution().executedPlan())

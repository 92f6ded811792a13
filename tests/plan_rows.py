"""Rows that the operators of an executed plan gave out."""


def rows_out(df, names):
    """Collected rows, and the largest row count of any executed node whose name holds one of ``names``."""
    rows, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        metric = node.metrics().get("numOutputRows")
        if any(name in node.nodeName() for name in names) and metric.isDefined():
            most = max(most, metric.get().value())
    return rows, most

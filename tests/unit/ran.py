"""What a plan has shuffled once it has run."""


def moved(df, column=None):
    """Rows with `column`, or bytes of all rows if none is named, that the plan of `df` has shuffled."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec" and (column is None or any(node.output().apply(i).name() == column for i in range(node.output().size()))):
                total += node.metrics().apply("dataSize" if column is None else "shuffleRecordsWritten").value()
            children = node.children()
            todo.extend(children.apply(i) for i in range(children.size()))
    return total

"""What the shuffles of a query that has run wrote, from its final plan."""


def exchanges(df):
    """(rows written, output columns) of each shuffle of ``df``, whose rows have been collected."""
    nodes, found = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], []
    while nodes:
        node = nodes.pop()
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())] + ([node.plan()] if node.nodeName().endswith("QueryStage") else [])
        if node.nodeName() == "Exchange":
            found.append((node.metrics().apply("shuffleRecordsWritten").value(), node.output().mkString(" ")))
    return found

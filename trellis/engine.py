"""The engine: run, explain, index statements, parameters, timeouts."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame

from .plans.compiler import MAX_HOPS, Compiler
from .plans.nodes import Index
from .plans.parser import parse
from .sources.graph import PropertyGraph


class Engine:
    """Queries over one graph. into: "join" lets parallel closing edges multiply rows, "exists" keeps the row once."""

    def __init__(self, graph: PropertyGraph, into: str = "join", max_hops: int = MAX_HOPS):
        self.graph, self.into, self.max_hops = graph, into, max_hops

    def run(self, text: str, params: dict | None = None) -> DataFrame:
        """The result of the last statement of text. No Spark job runs before the DataFrame is used, but for
        stored edges, frontiers that meet large ones, and walks without an upper bound."""
        q = parse(text)
        if isinstance(q, Index):
            return self.graph.spark.createDataFrame([(self.graph.index(q.label, q.key, q.create),)], "result string")
        return Compiler(self.graph, params, self.into, self.max_hops).compile(q)

    def explain(self, text: str, params: dict | None = None) -> str:
        """The clauses, then Spark's formatted plan."""
        q = parse(text)
        if isinstance(q, Index):
            return str(q)
        df = Compiler(self.graph, params, self.into, self.max_hops).compile(q)
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join(map(str, q)) + "\n\n" + plan

    def profile(self, text: str, params: dict | None = None) -> list[tuple[str, dict[str, int]]]:
        """Runs the query; each step of the plan that ran, from the result down, with Spark's metrics of it."""
        df = self.run(text, params)
        df.collect()
        out, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                node = node.executedPlan()
            found, it = {}, node.metrics().iterator()
            while it.hasNext():
                kv = it.next()
                if kv._2().value():
                    found[kv._1()] = kv._2().value()
            out.append((node.nodeName(), found))
            below = node.plan() if node.nodeName().endswith("QueryStage") else None
            children = [below] if below is not None else [node.children().apply(k) for k in range(node.children().size())]
            todo += reversed(children)
        return out

    def collect(self, text: str, params: dict | None = None, timeout: float | None = None) -> list:
        """Rows of the result; the query's jobs are cancelled after timeout seconds."""
        df = self.run(text, params)
        if timeout is None:
            return df.collect()
        spark, tag = self.graph.spark, f"trellis-{uuid.uuid4().hex}"
        spark.addTag(tag)
        timer = threading.Timer(timeout, spark.interruptTag, [tag])
        timer.start()
        try:
            return df.collect()
        finally:
            timer.cancel()
            spark.removeTag(tag)

"""All core queries and their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from flowmill.plans import attack_queries, clean_queries, eval_queries, flow_queries, graph_queries, io_queries, loss_queries, model_queries, skew_queries, split_queries, stream_queries

MODULES = (skew_queries, clean_queries, split_queries, graph_queries, flow_queries, eval_queries, model_queries, attack_queries, stream_queries, io_queries, loss_queries)
FLAGSHIP = "node_stats_long"


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

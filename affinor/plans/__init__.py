"""Registered queries, one module per area."""
from importlib import import_module

AREAS = ("q_items", "q_topics", "q_vectors", "q_resolve", "q_text", "q_graph", "q_recommend", "q_trend", "q_audit",
         "q_search", "q_report", "q_iterative")


def load_all() -> None:
    for a in AREAS:
        import_module(f"affinor.plans.{a}")

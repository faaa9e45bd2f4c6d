"""All queries; importing a module registers its queries."""

from importlib import import_module

from quern import ship_by_value
from quern.plans.registry import ORACLE, QUERIES

ship_by_value()

for _name in ("metrics_q", "corpus_q", "inference_q", "text_q", "wire_q", "more_q", "evidence_q", "records_q", "splits_q", "mining_q", "inference2_q", "sources_q", "wires_q", "samplers_q"):
    import_module(f"quern.plans.{_name}")

__all__ = ["ORACLE", "QUERIES"]

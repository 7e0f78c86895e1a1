"""Imports every query module, which fills the registry."""

from ledgerlens.plans import (  # noqa: F401
    queries_accounts,
    queries_eval,
    queries_graph,
    queries_scoring,
    queries_stream,
)
from ledgerlens.plans.registry import REGISTRY  # noqa: F401

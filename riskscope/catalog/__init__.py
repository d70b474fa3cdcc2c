"""All registered queries."""

from riskscope.catalog import changes, code, evaluate, modelling, plans, profile, prompting, retrieve, storage  # noqa: F401
from riskscope.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries: the operators applied to the driver's tables, each with SQL that says the same independently."""

from loomline.plans.registry import ORACLES, QUERIES, load

__all__ = ["ORACLES", "QUERIES", "load"]

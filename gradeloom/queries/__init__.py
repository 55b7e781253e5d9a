"""Queries over the provided tables, one for each operator."""

from gradeloom.plans.catalog import ORACLES, QUERIES
from gradeloom.queries import boxes, checks, evaluation, governance, inspection, labels, ordered, records, references, streams

__all__ = ["ORACLES", "QUERIES", "boxes", "checks", "evaluation", "governance", "inspection", "labels", "ordered", "records", "references", "streams"]

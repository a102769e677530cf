"""Importing this package fills the query registry."""

from skyfence.plans import detect, ingest, respond, risk, views  # noqa: F401
from skyfence.plans import stream  # noqa: F401  (needs the others registered)
from skyfence.plans.base import ORACLES, QUERIES  # noqa: F401

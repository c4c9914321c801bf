"""Import every query module so the registry is complete."""

from . import q_cohort, q_eval, q_model, q_results, q_tables  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

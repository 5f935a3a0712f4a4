"""All queries of the subpackage; importing this module registers them."""

from arcloom.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13  # noqa: F401
from arcloom.llm.registry import ORACLES, QUERIES  # noqa: F401

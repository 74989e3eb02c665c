"""The queries of this subpackage: each module named here has NAME, query and, where SQL can express it, SQL."""

from importlib import import_module

MODULES = ["q_op1", "q_op2", "q_op3", "q_op4", "q_op5", "q_op6", "q_op7", "q_op8", "q_op9", "q_op10"]


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in _modules() if getattr(m, "SQL", None)}

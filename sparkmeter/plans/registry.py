"""Named queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from . import record_queries as _record_queries  # noqa: F401  registers its queries
from . import state_queries as _state_queries  # noqa: F401
from .oracles import ORACLES
from .queries import QUERIES
from .record_oracles import ORACLES as RECORDS
from .state_oracles import ORACLES as STATES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | RECORDS | STATES

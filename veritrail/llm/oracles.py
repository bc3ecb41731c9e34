"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from . import licenses, mixing


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.oracle(), "op8_source_mixing": mixing.ORACLE}

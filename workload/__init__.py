"""The library's dataflows over the given star-schema tables, with SQL for comparison."""

from __future__ import annotations


def all_queries():
    """(queries, SQL) of every module."""
    from workload import (  # noqa: F401
        answer_queries,
        cohort_queries,
        document_queries,
        file_queries,
        gate_queries,
        member_queries,
        question_queries,
    )
    from workload.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)

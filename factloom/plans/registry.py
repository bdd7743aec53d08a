"""All registered queries of the library."""

from __future__ import annotations

from factloom.plans import derive_queries, document_queries, incremental_queries, inputs, report_queries, service_queries, source_queries, text_queries  # noqa: F401


def flagship(spark, sf_dir):
    """What must be regenerated between two versions of the call graph."""
    return incremental_queries.g07_incremental_plan(spark, sf_dir)


def queries() -> dict:
    return dict(inputs.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(inputs.ORACLES)

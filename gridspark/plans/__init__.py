"""End products composed of operators, and the registered queries over the driver tables."""


def load_queries() -> None:
    """Import the modules that register queries."""
    from gridspark.plans import (queries_fields, queries_forcing, queries_jobs, queries_products, queries_scenarios,  # noqa: F401
                                 queries_sources, queries_statistics)

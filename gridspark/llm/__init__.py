"""Operations of a training-data pipeline: fingerprints, records, shards, filters, classifiers, joins, packing.

Nothing else in the library imports this subpackage.  ``load_queries`` registers its queries.
"""


def load_queries() -> tuple[dict, dict]:
    """(queries, SQL oracles) of this subpackage."""
    from gridspark.llm import queries

    return dict(queries.QUERIES), dict(queries.ORACLES)

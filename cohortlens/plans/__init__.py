"""Registered queries over the driver tables."""

from __future__ import annotations


def load_catalog():
    """(queries, oracles) after every query module has registered itself."""
    from cohortlens.plans import (catalog, drift_queries, feature_queries, metric_queries, model_queries,  # noqa: F401
                                  profile_queries, quality_queries, risk_queries, stream_queries)

    return dict(catalog.QUERIES), dict(catalog.ORACLES)

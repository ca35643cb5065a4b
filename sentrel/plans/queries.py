"""All registered queries."""

from sentrel.plans import (  # noqa: F401
    control_queries,
    dataset_queries,
    file_queries,
    flow_queries,
    identity_queries,
    incident_queries,
    late_queries,
    model_checks,
    model_queries,
    nearness_queries,
    pattern_queries,
    quality_queries,
    sensor_queries,
    view_queries,
)
from sentrel.plans.registry import ORACLES, QUERIES  # noqa: F401

"""All registered queries with their SQL."""

from flowpanel.catalog import evaluation_queries, panel_queries, series_queries  # noqa: F401
from flowpanel.catalog.inputs import Inputs  # noqa: F401
from flowpanel.catalog.registry import ORACLES, PLAIN, QUERIES  # noqa: F401

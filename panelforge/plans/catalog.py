"""Imports every query module so that their ``@query`` registrations run."""

from panelforge.plans import queries_relational  # noqa: F401
from panelforge.plans import queries_stats  # noqa: F401
from panelforge.plans import queries_time  # noqa: F401
from panelforge.plans import queries_cluster  # noqa: F401
from panelforge.plans import queries_models  # noqa: F401
from panelforge.plans import queries_forecast  # noqa: F401
from panelforge.plans import queries_ranks  # noqa: F401
from panelforge.plans import queries_reports  # noqa: F401
from panelforge.plans import aliases  # noqa: F401  (after all registrations)
from panelforge.plans.registry import ORACLES, QUERIES  # noqa: F401

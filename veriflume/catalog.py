"""All registered queries of the library."""

from .plans import campaign, curation, joins, models, molecules, statistics, structures  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401

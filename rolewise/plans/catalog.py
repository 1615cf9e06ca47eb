"""All registered queries, in the order of the modules."""

from rolewise.plans import queries_scoring  # noqa: F401
from rolewise.plans import queries_evaluation  # noqa: F401
from rolewise.plans import queries_people  # noqa: F401
from rolewise.plans import queries_search  # noqa: F401
from rolewise.plans import queries_ingest  # noqa: F401
from rolewise.plans.registry import ORACLES, QUERIES  # noqa: F401

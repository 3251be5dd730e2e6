"""All queries of the library but those of the training-data subpackage."""

from .operators import metadata, relational  # noqa: F401  they register themselves
from .operators.registry import ORACLES, QUERIES

QUERIES["except"], ORACLES["except"] = QUERIES.pop("except_"), ORACLES.pop("except_")

"""Every query of the library outside the optional subpackage, and its SQL."""

from murmur.plans import automation, campaigns, changes, desk, feeds, imports, sends, trees  # noqa: F401
from murmur.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401

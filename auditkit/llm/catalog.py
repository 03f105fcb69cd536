"""All queries of the subpackage."""

from auditkit.llm import queries  # noqa: F401
from auditkit.llm.registry import QUERIES, SQL  # noqa: F401

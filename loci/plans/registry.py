"""All queries of the library."""

from __future__ import annotations

from loci.plans import base, embedding, relations, skew, texts  # noqa: F401
from loci.plans import more  # noqa: F401  (after the others: it adds names to theirs)

FLAGSHIP = "op_retrieve"
QUERIES = {**skew.QUERIES, **base.QUERIES}
ORACLES = {**skew.ORACLES, **base.ORACLES}

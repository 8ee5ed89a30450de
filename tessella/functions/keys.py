"""Column expressions for written keys: DOIs, splits, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand before a DOI, and the shape of a bare one.
DOI_LEAD = r"(?i)^(doi:|https?://(dx\.)?resolver\.example/)"
DOI_SHAPE = r"^10\.[0-9]{4,9}/\S+$"


def plain_key(c: Column) -> Column:
    """Lower case without outer white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def bare_doi(c: Column) -> Column:
    """The bare lower-case DOI of a written form, null where it is none.

    Outer white space and one lead (``doi:`` or the resolver's address, any case) are dropped,
    with white space after the lead; ``10.``, four to nine digits, ``/`` and a rest without white space remain.
    """
    x = F.regexp_replace(plain_key(c), DOI_LEAD, "")
    x = F.regexp_replace(x, r"^[\s\p{Z}]+", "")
    return F.when(x.rlike(DOI_SHAPE) & ~x.rlike(r"[\p{Z}]"), x)

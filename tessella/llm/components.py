"""Problem 5: pairwise matches to groups, by alternating large-star and small-star rewrites.

Large-star links each larger neighbour of a node to the least node of its neighbourhood; small-star
does so with the smaller ones. Both only rewrite edges, so their number never grows past a constant
times the nodes. When an alternation leaves the edges as they were, each node hangs on the minimum
of its component.

Nulls, self-links and repeated rows tie nothing. An empty table gives no rows. A hub, which may hold
a third of all edges, is pre-aggregated to its minimum and looked up by broadcast.
"""

from __future__ import annotations

from tessella.operators.stars import large_star, small_star, star_components

__all__ = ["TYING", "large_star", "small_star", "star_components"]

#: Kinds whose rows tie two units. Fixed values.
TYING = ("exact_native_source_bytes", "normalized_text", "word5gram_jaccard_ge_0.8")

"""Problem 6: loading rows of which some fail to parse.

A block of rows goes through a columnar path that handles it as a whole. A step that can only succeed or fail for the whole block, as decoding,
is repeated on halves of a failing block until the bad rows stand alone. Where the columnar path can tell itself which rows don't
fit, it says so. Either way bad rows are taken out and diagnosed strictly, one by one, and sound rows never are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def bisect(block: pa.RecordBatch, step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Blocks that together hold every row, in order: what ``step`` made of them and True, or single rows it fails on and False."""
    if not block.num_rows:
        return
    try:
        yield step(block), True
        return
    except pa.ArrowInvalid:
        if block.num_rows == 1:
            yield block, False
            return
    half = block.num_rows // 2
    yield from bisect(block.slice(0, half), step)
    yield from bisect(block.slice(half), step)


def parser(decode: Callable[[pa.RecordBatch], pa.RecordBatch], load: Callable[[pa.RecordBatch], tuple[pa.RecordBatch, np.ndarray]], strict: Callable[[pa.RecordBatch], pa.RecordBatch], schema: pa.Schema):
    """A function for ``mapInArrow``.

    ``decode`` adds columns to a block or raises ArrowInvalid; ``load`` gives the parsed rows of a decoded block, and a mask of
    those among its rows that don't fit; ``strict`` parses raw rows one by one, with their faults.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, bad = [], []
            for block, done in bisect(b, decode):
                (good if done else bad).append(block)
            out = []
            for block in pa.Table.from_batches(good).combine_chunks().to_batches() if good else []:
                loaded, odd = load(block)
                out.append(loaded)
                if odd.any():
                    bad.append(block.filter(pa.array(odd)).select(b.schema.names))
            if bad:
                out += [strict(x) for x in pa.Table.from_batches(bad).combine_chunks().to_batches()]
            if out:
                yield from pa.Table.from_batches(out, schema).combine_chunks().to_batches()

    return run

"""Whole groups of rows out of sorted Arrow batches, many groups at a time."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of the groups that are handled together; a larger group comes alone.
ROWS = 1 << 16


def group_starts(table, keys) -> np.ndarray:
    """First row of every group; rows with equal ``keys`` follow each other, nulls are equal."""
    fresh = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        column = table.column(key)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        a, b = column.slice(1), column.slice(0, table.num_rows - 1)
        other = pc.fill_null(pc.not_equal(a, b), False)
        fresh |= other.to_numpy(zero_copy_only=False)
        if column.null_count:
            fresh |= pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, fresh)) if table.num_rows else np.empty(0, np.int64)


def whole_groups(batches, keys, rows=ROWS):
    """Tables of whole groups, about ``rows`` rows each, from batches sorted by ``keys``."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        last = int(group_starts(table, keys)[-1])
        # A group that is not over yet is looked at again when it has doubled.
        if last:
            yield table.slice(0, last)
            held, count = table.slice(last).to_batches(), 0
        else:
            count = 0 if table.num_rows < 2 * rows else rows - table.num_rows
    if held:
        yield pa.Table.from_batches(held)

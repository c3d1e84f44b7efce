"""Arrow batches of bounded size, and results kept for equal inputs, within a Python worker."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import pyarrow as pa

#: Bytes after which a Python operator hands over what it has produced.
FLUSH_BYTES = 8 << 20
#: Bytes of inputs and results that a memo holds.
MEMO_BYTES = 16 << 20


class Output:
    """Collects rows (tuples) of a schema; ``full`` once they hold about FLUSH_BYTES."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size + 64

    @property
    def full(self) -> bool:
        return self.bytes >= FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(self.schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return made


class Memo:
    """Results of equal inputs, computed once; emptied when it holds more than MEMO_BYTES. Results must not be changed."""

    def __init__(self):
        self.held, self.bytes = {}, 0

    def get(self, key: Hashable, made: Callable, size: Callable[[object], int]):
        found = self.held.get(key)
        if found is None:
            found = made()
            cost = size(found) + 256
            if cost <= MEMO_BYTES // 4:
                if self.bytes + cost > MEMO_BYTES:
                    self.held, self.bytes = {}, 0
                self.held[key] = found
                self.bytes += cost
        return found


_memos: dict[Hashable, Memo] = {}


def memo(*of: Hashable) -> Memo:
    """The Python worker's memo of an operator and its parameters, kept from task to task; a worker has at most four."""
    if of not in _memos and len(_memos) >= 4:
        _memos.clear()
    return _memos.setdefault(of, Memo())

"""Arrow batches in blocks of bounded size, and texts as numbers of their distinct words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_ROWS = 2048
BLOCK_BYTES = 8 << 20


def blocks(batches: Iterator[pa.RecordBatch], column: int | str | Callable[[pa.RecordBatch], pa.Array], rows: int = BLOCK_ROWS, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and of at most so many bytes in the column unless one row has more."""
    for batch in batches:
        texts = column(batch) if callable(column) else batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, before + most, "right"))
            stop = min(max(stop, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(column: pa.Array) -> pa.Array:
    """The column with null as the empty text."""
    return pc.fill_null(column, "")


class Words:
    """The words of each text of a block: words(i) are order[bounds[i] : bounds[i + 1]], numbers in distinct."""

    def __init__(self, lists: pa.Array):
        coded = lists.flatten().dictionary_encode()
        self.values: pa.Array = coded.dictionary
        self.distinct: list[str] = self.values.to_numpy(zero_copy_only=False).tolist()
        self.order: np.ndarray = coded.indices.to_numpy()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        self.bounds: np.ndarray = bounds - bounds[0]

    @property
    def lengths(self) -> np.ndarray:
        """Code points of each distinct word."""
        return pc.utf8_length(self.values).to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def edged(self) -> np.ndarray:
        """Which distinct words are empty or have white space at an end."""
        n = pc.binary_length(self.values)
        return pc.or_(pc.equal(n, 0), pc.not_equal(n, pc.binary_length(pc.utf8_trim_whitespace(self.values)))).to_numpy(zero_copy_only=False)

    def texts_with(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold one of the distinct words marked in wanted."""
        places = np.flatnonzero(wanted[self.order]) if wanted.any() else np.zeros(0, np.int64)
        return np.unique(np.searchsorted(self.bounds, places, "right") - 1)


def split_at_spaces(texts: pa.Array) -> Words:
    """Words between single spaces; a word is empty where two spaces meet and at a space at either end."""
    return Words(pc.split_pattern(texts, " "))


def split_at_white_space(texts: pa.Array) -> Words:
    """Maximal runs of characters other than space and U+0009 to U+000D; a text may also hold empty words at its ends."""
    return Words(pc.ascii_split_whitespace(texts))

"""Byte-level words that several operators share: ASCII lower-casing and splitting at C speed."""

from __future__ import annotations

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z to a-z, every other ASCII byte but digits and letters to a blank; bytes of non-ASCII letters stay.
LETTERS = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else LOWER[c] for c in range(256))


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words between blanks and controls 09-0D."""
    return text.translate(LOWER).split()


def letter_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters and digits and of non-ASCII bytes."""
    return text.translate(LETTERS).split()


def slices(batches, rows: int = 512):
    """Arrow batches cut into slices, so that few texts at once are Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def text_bytes(batch, column: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]

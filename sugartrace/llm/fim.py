"""Fill-in-middle: documents cut at two unit borders and put together again with the middle last.

A unit is a word with the white space before it, or white space at the end of the text. One fullmatch of `(unit)*`
keeps every repetition of its group, so `ends(1)` holds all borders at once: its length is the number of units and
both cuts are entries of it.

Null texts are empty. An empty text, and one that already holds a marker, stays plain. Repeated rows are transformed
each, with equal results; a null key is drawn as if its digits were empty. A table without rows gives none, and columns besides key and text are not read.
A text is one match, without backtracking; one of over LONG characters is matched in stretches of LONG units from border
to border, since a match keeps some 300 bytes a unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace.llm.common import small_batches

LONG = 250_000
UNIT = r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
UNITS = regex.compile(UNIT + "*+")
STRETCH = regex.compile(UNIT + f"{{1,{LONG}}}+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50  # per cent of documents transformed
SUFFIX_FIRST = 80  # per cent of those that begin with the suffix

COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
FORMAT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.string()),
    ]
)


def borders(text: str) -> list[int]:
    """Where each unit ends."""
    if len(text) <= LONG:
        return UNITS.fullmatch(text).ends(1)
    ends: list[int] = []
    while not ends or ends[-1] < len(text):
        ends += STRETCH.match(text, ends[-1] if ends else 0).ends(1)
    return ends


def draws(key: int | None, seed: int) -> tuple[int, int, int, int]:
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


def transform(
    key: int | None, text: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and middle, and the text put together anew."""
    ends = borders(text)
    n = len(ends)
    one, two, chance, order = draws(key, seed)
    if not text or chance % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    ends.insert(0, 0)
    a, b = sorted((ends[one % (n + 1)], ends[two % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id", **choices: int) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one for each row of `docs`."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            done = [(k, *transform(k, t, **choices)) for k, t in zip(keys, texts)]
            columns = zip(*done) if done else [[]] * len(FORMAT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FORMAT)], schema=FORMAT)

    return rows.mapInArrow(batches, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. Texts with markers stay plain, so in the other forms each marker stands once:
    one that began or ended in a neighbouring part would have to overlap a true one, and no marker does."""
    parts = F.split(output, "<[PSM]>")
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def middle_rows(docs: DataFrame) -> DataFrame:
    rows = transformed(docs)
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )

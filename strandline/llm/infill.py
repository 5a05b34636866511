"""Fill-in-middle transformation: an Arrow pipeline over lists of code points, and its inverse in built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Marks before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Roles of a unit, in the order of the text.
BEFORE, WITHIN, AFTER = 0, 1, 2
#: A batch is cut so that its texts hold about so many bytes (one text at least): the unit arrays take some 30 bytes a unit.
SLICE_BYTES = 4 << 20


def hash_words(id_col: Column) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of '1:' and the decimal id (null: no digits), as longs."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _code_points(texts: pa.StringArray) -> pa.ListArray:
    """Every text as a list of its code points: string slices over the text's own bytes, which are not copied."""
    size = len(texts)
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, np.int32)[texts.offset:texts.offset + size + 1] if size else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[starts[0]:starts[-1]] if data is not None else np.zeros(0, np.uint8)
    first = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
    lists = np.searchsorted(first, starts - starts[0]).astype(np.int32)
    units = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, np.int32(len(raw)))), pa.py_buffer(raw))
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), units)


def _pieces(units: pa.StringArray, parent: pa.Array, chosen: pa.Array, rows: int) -> pa.StringArray:
    """The chosen units joined again, one text a row."""
    kept, of = pc.filter(units, chosen), pc.filter(parent, chosen)
    offsets = np.searchsorted(of.to_numpy(), np.arange(rows + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept), "")


def _transform(texts: pa.StringArray, hashes: list[pa.Array], plain_of_100: int, spm_of_100: int) -> list[pa.Array]:
    rows = len(texts)
    lists = _code_points(texts)
    n = pc.cast(pc.list_value_length(lists), pa.int64())
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    start = pa.array(np.asarray(lists.offsets)[:-1], pa.int64()) if rows else pa.array([], pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(units)), pa.int64()), pc.take(start, parent))
    cuts = [pa.array(h.to_numpy() % (n.to_numpy() + 1), pa.int64()) for h in hashes[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    h3, h4 = (h.to_numpy() % 100 for h in hashes[2:])
    plain = pc.or_(pc.or_(pc.equal(n, 0), marked), pa.array(h3 >= plain_of_100, pa.bool_()))
    spm = pa.array(h4 < spm_of_100, pa.bool_())
    role = pc.add(pc.cast(pc.greater_equal(ordinal, pc.take(low, parent)), pa.int8()), pc.cast(pc.greater_equal(ordinal, pc.take(high, parent)), pa.int8()))
    before, within, after = (_pieces(units, parent, pc.equal(role, pa.scalar(r, pa.int8())), rows) for r in (BEFORE, WITHIN, AFTER))
    psm_text = pc.binary_join_element_wise(PREFIX, before, SUFFIX, after, MIDDLE, within, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, after, PREFIX, before, MIDDLE, within, "")
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    none = pa.scalar(None, pa.int64())
    return [n, form, pc.if_else(plain, none, low), pc.if_else(plain, none, pc.subtract(high, low)), output]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_of_100: int = 90, spm_of_100: int = 20) -> DataFrame:
    """docs without text_col plus n, form (plain, psm, spm), prefix_chars, middle_chars and output.

    A text is cut in three at two places drawn by hash from the id; fim_of_100 of 100 texts are rearranged, spm_of_100 of
    those with the suffix first. Each Arrow batch runs one pipeline: texts split into lists of code points, flattened with
    parent indices, ordinals within the text, units filtered by role, lists rebuilt and joined. No shuffle; memory
    follows a slice of SLICE_BYTES, or one text where that is longer.

    Null texts count as empty and stay plain, as do texts that hold a mark; null ids draw from the hash of no digits;
    repeated rows and rows of equal ids are cut alike where their texts have equal lengths; long texts are cut whole; an empty table
    gives none; columns of docs with the name of a new one are replaced.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    rest = [c for c in docs.columns if c not in (*made, text_col)]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
                       *[h.alias(f"_h{k}") for k, h in enumerate(hash_words(F.col(f"`{id_col}`")))])
    out = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:len(rest)]), "n long, form string, prefix_chars long, middle_chars long, output string"])
    schema = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(len(rest))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                texts = part.column(len(rest))
                texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
                found = _transform(texts, part.columns[len(rest) + 1:], fim_of_100, spm_of_100)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(rest)], *found], schema=schema)
                lo = hi

    return rows.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone; the first of each mark after the one before it ends a part."""
    body = output.substr(F.lit(len(PREFIX) + 1), F.length(output))
    turn = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = body.substr(F.length(first) + F.length(turn) + 1, F.length(body))
    second = F.substring_index(rest, MIDDLE, 1)
    middle = rest.substr(F.length(second) + len(MIDDLE) + 1, F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))

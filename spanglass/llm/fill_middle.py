"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, and put together in another order.

The work is SQL on DuckDB inside mapInArrow: each batch is registered as a table there and the answer comes back as Arrow, so no row passes
through Python.  Cuts lie between tokens (a word with the white space before it, or white space at the end);
which, and in which form a text is given, is drawn from the SHA-256 of a seed and the document's id, so every run draws the same.

    plain   the text: half of the documents, and texts that are empty or hold one of the marks
    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanglass.llm.memory import give_back

SEED, PLAIN_FROM, SPM_BELOW = 42, 50, 80
TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BATCH_BYTES = 8_000_000


def _draw(i: int) -> str:
    return f"('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT"


def _transform_sql(seed: int, plain_from: int, spm_below: int) -> str:
    return f"""
WITH a AS (SELECT row, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS h FROM batch),
b AS (SELECT row, text, regexp_extract_all(text, '{TOKENS}') AS w, h,
        text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_draw(2)} % 100 >= {plain_from} AS plain FROM a),
c AS (SELECT *, len(w) AS n, {_draw(0)} % (len(w) + 1) AS i, {_draw(1)} % (len(w) + 1) AS j FROM b),
d AS (SELECT row, text, n, CASE WHEN plain THEN 'plain' WHEN {_draw(3)} % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form,
        CASE WHEN NOT plain THEN array_to_string(list_slice(w, 1, least(i, j)), '') END AS prefix,
        CASE WHEN NOT plain THEN array_to_string(list_slice(w, least(i, j) + 1, greatest(i, j)), '') END AS middle,
        CASE WHEN NOT plain THEN array_to_string(list_slice(w, greatest(i, j) + 1, n), '') END AS suffix FROM c)
SELECT row, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
            ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM d ORDER BY row"""


#: Texts in another form hold no mark, and no mark can begin in one piece and end in the next, so the first of each kind is the one put in.
_RESTORE_SQL = f"""
WITH a AS (SELECT row, output, form, strpos(output, '{PREFIX}') AS p, strpos(output, '{SUFFIX}') AS s, strpos(output, '{MIDDLE}') AS m FROM batch)
SELECT row, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN output[4:s - 1] || output[m + 3:] || output[s + 3:m - 1]
                      WHEN 'spm' THEN output[p + 3:m - 1] || output[m + 3:] || output[4:p - 1] END AS restored
FROM a ORDER BY row"""


def _parts(batch: pa.RecordBatch, sized: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some megabytes of the text column, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _BATCH_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _by_sql(df: DataFrame, sql: str, given: list[tuple[str, str]], added: str, keep: list[str] | None) -> DataFrame:
    """``df`` with the columns ``added``, which ``sql`` gives for the table ``batch`` of the columns ``given`` (column, its name there)."""
    new = T.StructType.fromDDL(added)
    clash = sorted(set(new.names) & {c.lower() for c in (df.columns if keep is None else keep)})
    if clash:
        raise ValueError(f"columns {clash} are there already")
    kept = df.columns if keep is None else keep
    source = df.select(*kept, *(df[c].alias(f"__given_{i}") for i, (c, _) in enumerate(given)))
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        for whole in batches:
            for batch in _parts(whole, n):
                names = ["row", *(name for _, name in given)]
                table = pa.Table.from_arrays([pa.array(np.arange(batch.num_rows)), *batch.columns[n:]], names=names)
                con.register("batch", table)
                found = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                columns = [*batch.columns[:n], *(found.column(c).combine_chunks() for c in new.names)]
                flat = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(flat, names=[*kept, *new.names])
        con.close()
        give_back()

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in kept), *new.fields]))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with n, form, prefix_chars, middle_chars and output.

    Of a hundred documents about ``plain_from`` change, ``spm_below`` of a hundred of these to ``spm``.  A null text counts as empty and gives an empty
    output, a null id is drawn for as an empty one; rows that share an id are cut at the same draws.  White space alone is one token.
    Whole texts are cut, however long; n is a token count, the others are code points and null for plain.
    Columns of the added names raise an error.  An empty table gives no rows.
    """
    sql = _transform_sql(seed, plain_from, spm_below)
    return _by_sql(docs, sql, [(text_col, "text"), (id_col, "id")], "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string", keep)


def restored(docs: DataFrame, *, output_col: str = "output", form_col: str = "form", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``restored``, the text rebuilt from output and form; null for a null output or another form."""
    return _by_sql(docs, _RESTORE_SQL, [(output_col, "output"), (form_col, "form")], "restored string", keep)

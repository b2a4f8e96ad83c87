"""Fill-in-middle forms of documents, worked out by DuckDB inside tasks.

Each Arrow batch is registered with an in-process DuckDB connection as table `batch`, and one SQL statement cuts, rearranges and restores its texts; the
result goes back as Arrow, so no Python code sees a single row. Batches are cut into slices of about 3 MB of text, and one thread works on a slice, so
memory is that of a slice's units (some 60 bytes a unit) or of the longest text's.

Units are words of ASCII letters and single other characters. Prefix, middle and suffix are bounded by two numbers of units drawn from a hash of the
document's id, and stand either in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each behind its sentinel.

Defined results: null and empty texts, and texts that hold a sentinel, stay plain; a null doc_id counts as '' in the hash and stays null; repeated rows
are transformed each, equal ids draw equal numbers; bounds that fall together leave an empty middle; no documents give no rows. Only doc_id and text are
read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import frugal
from pricewren.llm.tokens import slices

UNITS = "[A-Za-z]+|[^A-Za-z]"
#: Of 100 documents that can be transformed, how many are; and of these, how many in the order suffix, prefix, middle.
RATE, SUFFIX_FIRST = 90, 20
TEXTS = {"output": "output", "restored": "restored"}
KINDS = {"doc_id": "long", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}


def statement(values: Mapping[str, str], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 1) -> str:
    """The SQL over table batch(doc_id, text). values: further columns as expressions of output and restored."""
    drawn = ", ".join(f"('0x' || substr(digest, {8 * i + 1}, 8))::UBIGINT AS h{i + 1}" for i in range(4))
    part = lambda a, b: f"CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(units, {a}, {b}), ''), '') END"
    held = " OR ".join(f"contains(text, '<{s}>')" for s in "PSM")
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS units,
    sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM batch),
drawn AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, {drawn} FROM cut),
formed AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN text = '' OR {held} OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, text, n, form, {part("1", "a")} AS prefix, {part("a + 1", "b")} AS middle, {part("b + 1", "n")} AS suffix FROM formed),
made AS (
  SELECT doc_id, n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts),
marked AS (SELECT *, instr(output, '<P>') AS p, instr(output, '<S>') AS s, instr(output, '<M>') AS m FROM made),
back AS (
  SELECT doc_id, n, form, prefix_chars, middle_chars, output,
    CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, s - 4) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
      ELSE substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, 4, p - 4) END AS restored FROM marked)
SELECT {", ".join([*KINDS, *(f"{e} AS {name}" for name, e in values.items())])} FROM back"""


def fill_in_middle(docs: DataFrame, values: Mapping[str, str] = TEXTS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) of every row of docs(doc_id, text), and the
    string columns that `values` names, as DuckDB expressions of `output` (the transformed text) and `restored` (the text rebuilt from it)."""
    sql = statement(values, rate, suffix_first, seed)

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        try:
            for batch in batches:
                for at, n in slices(batch.column("text")):
                    con.register("batch", pa.Table.from_batches([batch.slice(at, n)]))
                    yield from con.execute(sql).to_arrow_table().to_batches()
                    con.unregister("batch")
        finally:
            con.close()

    schema = ", ".join(f"{n} {k}" for n, k in (KINDS | dict.fromkeys(values, "string")).items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

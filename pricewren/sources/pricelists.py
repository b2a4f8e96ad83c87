"""Suppliers' price lists as tables: files of unknown encoding, delimiter and column order, or XLSX workbooks.

Each file is read as a whole by one task (`binaryFile`; price lists are small files, many of them); a small helper turns its bytes into cells,
and what a column holds is then decided by grouped sums over cells in Spark.
"""

from __future__ import annotations

import csv
import io
import re
import statistics
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.amounts import detect_currency, parse_amount_list

DELIMITERS = (";", ",", "\t", "|")
# Labels of columns by role.
LABELS = {
    "name": ("наименование", "артикул", "продукт", "описание", "name", "product", "description", "denumire"),
    "price": ("цена", "ед цена", "единична цена", "price", "unit price", "pret", "preț"),
    "shop_code": ("код", "арт", "артикулен номер", "code", "sku", "cod"),
    "unit": ("мярка", "м ед", "ме", "unit", "um"),
    "currency": ("валута", "currency", "moneda"),
}
#: Rows that a column's role is judged by where there is no header.
JUDGED = 200
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decoded(data: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8 if it is valid, else windows-1251; a byte order mark goes."""
    try:
        return data.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("cp1251", errors="replace"), "windows-1251"


def delimiter_of(text: str) -> str:
    """Of the first 20 filled lines, the delimiter that most lines hold equally often, then the more frequent one."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    best, most = DELIMITERS[0], 0.0
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        middle = statistics.median_low(counts) if counts else 0
        score = 100 * sum(c == middle for c in counts) + middle if middle else 0
        if score > most:
            best, most = d, score
    return best


def workbook_rows(data: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as texts."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = min(n for n in names if n.startswith("xl/worksheets/sheet"))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else i
                value = "".join(t.text or "" for t in c.iter() if t.tag in (f"{_MAIN}v", f"{_MAIN}t"))
                cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def cells_of(data: bytes) -> tuple[list[list[str]], str, str]:
    if data[:3] == b"PK\x03":
        rows, encoding, delimiter = workbook_rows(data), "xlsx", ""
    else:
        text, encoding = decoded(data)
        delimiter = delimiter_of(text)
        rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    rows = [[c.strip() for c in r] for r in rows]
    return [r for r in rows if any(r)], encoding, delimiter


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row and column (from 0), cell, encoding and delimiter of all files under a path."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows, encoding, delimiter = cells_of(bytes(data))
                yield pd.DataFrame([(name, i, j, c, encoding, delimiter) for i, r in enumerate(rows) for j, c in enumerate(r)], columns=["path", "row", "col", "cell", "encoding", "delimiter"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cells, "path string, row int, col int, cell string, encoding string, delimiter string")


def _label(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N} ]", " "), "\\s+", " "))


def _labelled(x: Column, role: str) -> Column:
    """Whether a header cell names a role: a label alone, or one followed by more words."""
    return F.exists(F.array(*[F.lit(v) for v in LABELS[role]]), lambda v: (x == v) | F.startswith(x, F.concat(v, F.lit(" "))))


def read_price_lists(spark: SparkSession, path: str) -> DataFrame:
    """path, row, name, price, shop_code, unit and currency of every row, with problem: null, `name` (under two characters) or `price`
    (unreadable). A header is a first row of two or more filled cells without numbers; without one, columns are told by their values."""
    cells = read_cells(spark, path).withColumn("amount", parse_amount_list(F.col("cell"))).persist()
    first = cells.where("row = 0 and cell <> ''").groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("amount").isNotNull()).alias("numbers"))
    headed = first.select("path", ((F.col("n") >= 2) & (F.col("numbers") == 0)).alias("headed"))
    label = _label(F.col("cell"))
    named = F.coalesce(*[F.when(_labelled(label, r), F.lit(r)) for r in ("shop_code", "unit", "currency", "price", "name")])
    by_label = cells.where("row = 0").join(headed.where("headed"), "path").select("path", "col", named.alias("role"), F.col("cell").alias("label")).where("role is not null")
    body = cells.join(headed, "path").where("row > 0 or not headed")
    values = body.where((F.col("row") <= JUDGED) & (F.col("cell") != "")).groupBy("path", "col").agg(
        F.avg(F.col("amount").isNotNull().cast("int")).alias("numeric"), F.avg(F.char_length("cell")).alias("length"), F.avg(F.col("cell").rlike("^[A-Za-z0-9./-]{2,24}$").cast("int")).alias("code")
    )
    known = by_label.select("path").distinct()
    open_ = values.join(known, "path", "left_anti")
    price = open_.where("numeric >= 0.8").groupBy("path").agg(F.max_by("col", F.struct("numeric", "col")).alias("col")).select("path", "col", F.lit("price").alias("role"))
    name = open_.where("numeric < 0.5").groupBy("path").agg(F.max_by("col", F.struct("length", -F.col("col"))).alias("col")).select("path", "col", F.lit("name").alias("role"))
    code = open_.where("code >= 0.8 and numeric < 0.8").groupBy("path").agg(F.min("col").alias("col")).select("path", "col", F.lit("shop_code").alias("role"))
    guessed = price.unionByName(name).unionByName(code.join(name.select("path", "col"), ["path", "col"], "left_anti"))
    nth = Window.partitionBy("path", "role").orderBy("col")
    roles = by_label.withColumn("nth", F.row_number().over(nth)).where("nth = 1").select("path", "col", "role", "label").unionByName(guessed.withColumn("label", F.lit("")))
    of = lambda r, x="cell": F.max(F.when(F.col("role") == r, F.col(x)))
    rows = body.join(roles, ["path", "col"]).groupBy("path", "row").agg(
        of("name").alias("name"), of("price", "amount").alias("price"), of("shop_code").alias("shop_code"), of("unit").alias("unit"),
        F.coalesce(of("currency"), detect_currency(of("price")), detect_currency(of("price", "label"))).alias("currency"),
    )
    problem = F.when(F.char_length(F.coalesce("name", F.lit(""))) < 2, "name").when(F.col("price").isNull(), "price")
    return rows.withColumn("problem", problem)

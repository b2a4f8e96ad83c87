from __future__ import annotations

import hashlib
import re

from pricewren.llm import fill_in_middle, queries
from tests.comparing import database, differences
from tests.llm.making import ODD, SF_DIR, crowded, documents, empty


def plainly(doc_id, text, rate=90):
    """n, form, prefix_chars, middle_chars and output, in plain Python."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_query_against_sql_and_plain_python(spark):
    out = queries.op12_fill_in_middle(spark, SF_DIR)
    assert not differences(out, database(SF_DIR), queries.FILL_SQL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(texts) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, p, m, output = plainly(r["doc_id"], texts[r["doc_id"]])
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (output, texts[r["doc_id"]])]
        assert [r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")] == [n, form, p, m, *sha]


def test_odd_rows(spark):
    odd = [*ODD, (11, "has <M> in it"), (12, "ends in <"), (13, "S> starts"), (14, "<<P <S< <M"), (15, "\r\n\t"), (16, "é" * 9)]
    rows = fill_in_middle.fill_in_middle(crowded(documents(spark, odd))).collect()
    key = lambda x: tuple(map(repr, x))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=key) == sorted(((i, *plainly(i, t)) for i, t in odd), key=key)
    assert sorted(r["restored"] for r in rows) == sorted(t or "" for _, t in odd)
    assert fill_in_middle.fill_in_middle(empty(spark)).count() == 0


def test_sentinel_parts_at_the_bounds(spark):
    texts = [(i, t) for i in range(200) for t in ("<", "<P", "S><", "a<S", ">M>", "<>PSM<")]
    rows = fill_in_middle.fill_in_middle(documents(spark, texts), rate=100).collect()
    assert sorted((r["doc_id"], r["restored"]) for r in rows) == sorted(texts)

"""Worked cases of functions, matching and sources."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from pricewren.functions import amounts, money, requests, text, units
from pricewren.operators import matching, textjoin
from pricewren.sources import pricelists, pricepages


def values(spark, function, xs, kind="string"):
    rows = spark.createDataFrame([*enumerate(xs)], f"n long, x {kind}")
    return [r[0] for r in rows.orderBy("n").select(function(F.col("x"))).collect()]


def test_amounts(spark):
    web = {"само 57,30 лв./бр.": 57.3, "2 040,50 лв": 2040.5, "EUR 3.480,05": 3480.05, "7,015.20 $": 7015.2, "от €61.07": 61.07, "от 61,07": 61.07, "8.400": 8400.0, "5.670.123,40": 5670123.4, "42": 42.0, "": None, "попитайте": None, "0,00": None, "...": None, "12.5": 12.5}
    assert values(spark, amounts.parse_amount_web, web) == [*web.values()]
    lists = {"7,05": 7.05, "3 071,40": 3071.4, "3.071,40": 3071.4, "3,071.40": 3071.4, "6.500": 6500.0, "7,05 лв.": 7.05, "€ 11,60": 11.6, "0": 0.0, "": None, "няма": None, "цена по договаряне": None, "-3": None}
    assert values(spark, amounts.parse_amount_list, lists) == [*lists.values()]
    signs = {"57,30 лв.": "BGN", "от €61.07": "EUR", "$7,015.20": "USD", "3480 EUR": "EUR", "£12": "GBP", "42": None, "15 lei": "RON"}
    assert values(spark, amounts.detect_currency, signs) == [*signs.values()]


def test_money(spark):
    assert values(spark, money.money_round, [1.005, -2.5, 2.675, None], "double") == [1.01, -2.5, 2.68, None]
    assert values(spark, lambda x: money.money_round(x, 0), [-2.5, 2.5], "double") == [-2.0, 3.0]
    assert values(spark, lambda x: money.convert(x, F.lit("BGN"), F.lit("EUR")), [195.583], "double") == [100.0]
    assert values(spark, lambda x: money.convert(x, F.lit("USD"), F.lit("EUR")), [100.0], "double") == [None]
    assert values(spark, money.trend, [None, 1.0, 1.01, -1.0, -1.01], "double") == ["unknown", "flat", "rising", "flat", "falling"]


def test_requests(spark):
    cases = {
        "NYM 5x4, 30": [("NYM 5x4", 30.0, None)], "проводник NYM 5х4, 75м": [("проводник NYM 5х4", 75.0, "м")], "ключ двоен 6 бр.": [("ключ двоен", 6.0, "бр")],
        "4 x ключ двоен": [("ключ двоен", 4.0, None)], "ключ двоен 16A": [("ключ двоен 16A", 1.0, None)], "aa, 2; bb, 3; c, 4": [("aa", 2.0, None), ("bb", 3.0, None)], " ; ": [], "dd, 0": [],
        "\n".join(["x"] * 60 + ["late, 5"]): [],
    }
    assert [[tuple(r) for r in x] for x in values(spark, requests.request_lines, cases)] == [*cases.values()]
    said = {
        "Продуктът е изчерпан": False, "produs indisponibil": False, "Ships today, in stock": True, "Produs disponibil": True, "Виж наличност": None, "in stock elsewhere, here out of stock": False,
        "не е наличен": False, "nu este în stoc": False, "unavailable": False, "discontinued": False, "not available": False, "Not in stock": False, "δεν είναι διαθέσιμο": False, "διαθέσιμο": True,
        "наличност: 0": False, "In stock: 0": False, "Stock 0 pcs": False, "in stock 0.5 l": True, "наличност: 14": None, "Наличен": True, "available": None, "available now": True, "инстокови": None, "stocked in Stockholm": None, "": None, None: None,
    }
    assert dict(zip(said, values(spark, requests.availability, said))) == said
    plans = {
        "Финансиране от Klarna: 6 вноски по 31,40 лв.": [(6, 31.4, "BGN", "Klarna")], "или 36 x 7 €": [(36, 7.0, "EUR", None)], "61 x 7 €": [], "1 x 7 €": [], "15.25 €/месец за 18 месеца": [(18, 15.25, "EUR", None)],
        "24 x 4.10 € и 10 x 9.05 €": [(10, 9.05, "EUR", None), (24, 4.1, "EUR", None)], "10 x 9.05 €. " + "." * 130 + " Paysera 10 x 9.05 €": [(10, 9.05, "EUR", "Paysera")], "номер 112 x 7.00 €": [],
    }
    assert [[tuple(r) for r in x] for x in values(spark, requests.instalments, plans)] == [*plans.values()]


def test_groups(spark):
    labels = {"ПРОВОДНИК NYY-J 5х16 СИВ": "ПРОВОДНИК 5Х16", "РОЛКА ГУМЕНА 40м": "РОЛКА", "Cable 4x6mm2 grey": "CABLE 4X6MM2", "Крушка (GU-B60-9W) 9W": "КРУШКА GU-B60-9W", "ДРОСЕЛ ДРОСЕЛ7X": "ДРОСЕЛ", "": "", " ": "", None: ""}
    assert values(spark, text.group_label, labels) == [*labels.values()]


def test_text(spark):
    assert values(spark, text.gtin_valid, ["5410288888880", "5410288888881", "12345670", "123"]) == [True, False, True, False]
    words = {"batteries": "battery", "boxes": "box", "glass": "glass", "lamps": "lamp", "bus": "bus"}
    assert values(spark, text.stem, words) == [*words.values()]
    pairs = spark.createDataFrame([("philips", "philps"), ("philips", "phiilps"), ("philips", "philips"), ("philips", "osram"), ("ab", "ba")], "a string, b string")
    assert [r[0] for r in pairs.select(text.one_edit_apart(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, True]
    hosts = {"https://www.Shop.example/a": "shop.example", "ftp://x": None, "http://a.b:80/": "a.b", None: None}
    assert values(spark, text.host_of, hosts) == [*hosts.values()]


def test_units(spark):
    rows = spark.createDataFrame([(100.0, "cm", 1.0), (250.0, "ml", 0.25), (1.0, "TB", 1000.0), (27.0, "zoll", 0.6858), (1.0, "s", None)], "v double, u string, base double")
    assert all(r[0] == r[1] for r in rows.select(units.to_base(F.col("v"), F.col("u")), "base").collect())
    assert values(spark, lambda x: units.convert_unit(x, F.lit("cm"), F.lit("kg")), [1.0], "double") == [None]
    assert units.dimension(spark).count() == len(units._ROWS)


MAKERS = ("ledvance", "vivalux", "lg", "schneider", "makita", "patona")


PAIRS = [
    ("Ledvance spot 5W GU10 4006381333931", "спот 4006381333931", "same_product", 1.0),
    ("контактор LC1D09M7 230V", "Контактор LC1-D09M7 24V", "conflict", 0.0),
    ("контактор LC1D09M7 230V", "Контактор LC1D09M7 черен", "same_product", 0.95),
    ("контактор LC1D09M7 черен", "Контактор LC1D09M7 бял", "same_family", 0.6),
    ("кабел 4mm черен", "кабел 4mm син", "same_type", 0.45),
    ("Ledvance LED 7W E14 2700K", "LEDVANCE LED CANDLE 7W E14 2700K", "same_product", 0.92),
    ("Ledvance LED 7W E14 2700K", "Ledvance Value LED 7W 827 E14", "same_product", 0.9),
    ("кабел 4x6", "Kabel 4x6 NYM", "same_product", 0.86),
    ("Makita X5Z батерия", "Patona батерия за Makita X5Z", "compatible", 0.72),
    ("Makita X5Z батерия", "Patona батерия X9Z", "conflict", 0.0),
    ("контактор LC1D09M7", "контактор LC1D12P7", "unrelated", 0.3),
    ("лампа", "настолна лампа бяла", "same_type", 0.75),
    ("лампа", "кабел", "conflict", 0.0),
    ("SSD 500GB", "SSD 250GB", "conflict", 0.0),
    ("ПРОВОДНИК ПВА 4x6", "ПРОВОДНИК ПВА 3x10", "conflict", 0.0),
    ("Ledvance LED 7W E14", "Vivalux LED 7W E14", "conflict", 0.0),
    ("Ledvance lamp 7W E14", "Ledvance lamp", "possible", 0.64),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = matching.interpret(spark.createDataFrame([p[:2] for p in PAIRS], "q string, c string"), "q", MAKERS, "q_")
    return {(r["q"], r["c"]): r for r in matching.scored(matching.relate(matching.interpret(rows, "c", MAKERS, "c_"))).collect()}


@pytest.mark.parametrize(("query", "candidate", "relation", "confidence"), PAIRS)
def test_matching(verdicts, query, candidate, relation, confidence):
    r = verdicts[query, candidate]
    assert r["relation"] == relation and (r["confidence"] == pytest.approx(confidence) or relation == "unrelated" and r["confidence"] <= confidence), r
    assert r["blocked"] == (relation == "conflict") and (r["score"] == 0) == r["blocked"]


def test_article_numbers_and_scores(spark):
    row = spark.createDataFrame([("lamp 7W", "lamp 9W", "AB-12", "ab 12"), ("lamp 7W red", "lamp 7W red", None, None), ("", None, "", "")], "q string, c string, n string, m string")
    row = matching.interpret(matching.interpret(row, "q", MAKERS, "q_", "n"), "c", MAKERS, "c_", "m")
    found = {r["q"]: r for r in matching.scored(matching.relate(row)).collect()}
    assert (found["lamp 7W"]["relation"], found["lamp 7W"]["method"], found["lamp 7W"]["confidence"]) == ("same_product", "sku", 0.99)
    # 0.3 * 0 + 0.35 * 1 + 0.12 * 1 + 0.1 * 0.5 + 0.05 * 1 + 0.08 * 0.6
    assert found["lamp 7W red"]["score"] == pytest.approx(0.62) and found["lamp 7W red"]["relation_group"] == "strong"
    assert found[""]["relation"] is not None


def test_candidates_lose_no_pair(spark):
    """All pairs of the rule that candidates() states are among its pairs, though common words are no keys."""
    nouns, makers = ("lamp", "cable", "pump"), ("ledvance", "makita")
    names = [f"{makers[i % 2] if i % 3 else ''} {nouns[i % 3]} {i % 5 + 5}W {'mx10%02dk' % (i % 9) if i % 4 == 0 else ''} {i % 4 + 1}x6 common words".strip() for i in range(60)] + ["lamp", "pump"]
    made = spark.createDataFrame(list(enumerate(names)), "n long, name string")
    q = matching.interpret(made.withColumnRenamed("n", "query_id"), "name", MAKERS, "q_").drop("name")
    c = matching.interpret(made.withColumnRenamed("n", "offer_id"), "name", MAKERS, "c_").drop("name")
    met = {(r[0], r[1]) for r in matching.candidates(q, c).select("query_id", "offer_id").collect()}
    everything = matching.evidence(q.crossJoin(c))
    wanted = everything.where("shared_gtin OR shared_sku OR arrays_overlap(q_models, c_models) OR identity_matches >= least(2, asked) AND asked > 0 OR similarity >= 0.4 OR bare AND arrays_overlap(q_words, c_words)")
    pairs = {(r[0], r[1]) for r in wanted.select("query_id", "offer_id").collect()}
    assert pairs and pairs <= met


def test_price_lists(spark, tmp_path):
    text_ = "Арт. №;Наименование на артикула;Мярка;Цена без ДДС (лв);Цена с ДДС\nSVT-3X25;КАБЕЛ СВТ 3x2.5;м;1,42;1,70\nLED-12;Лампа LED 12W E27;бр;3,20;3,84\nX;Без цена;бр;по запитване;\n"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + text_.encode())
    (tmp_path / "b.csv").write_bytes(text_.encode("cp1251"))
    (tmp_path / "c.txt").write_text('K-1\tFirst long article name\t1,50\nK-2\tSecond, with "comma"\t2,25\n')
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><t>price</t></si><si><t>Lamp</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>4.5</v></c></row></sheetData></worksheet>')
    rows = pricelists.read_price_lists(spark, str(tmp_path)).withColumn("file", F.regexp_extract("path", "([^/]*)$", 1)).orderBy("file", "row").collect()
    found = [(r["file"], r["name"], r["price"], r["shop_code"], r["unit"], r["currency"], r["problem"]) for r in rows]
    both = [("КАБЕЛ СВТ 3x2.5", 1.42, "SVT-3X25", "м", "BGN", None), ("Лампа LED 12W E27", 3.2, "LED-12", "бр", "BGN", None), ("Без цена", None, "X", "бр", "BGN", "price")]
    assert [f[1:] for f in found if f[0] == "a.csv"] == both and [f[1:] for f in found if f[0] == "b.csv"] == both
    assert [f[1:4] for f in found if f[0] == "c.txt"] == [("First long article name", 1.5, "K-1"), ('Second, with "comma"', 2.25, "K-2")]
    assert [f[1:3] for f in found if f[0] == "d.xlsx"] == [("Lamp", 4.5)]


def test_price_pages(spark, tmp_path):
    pages = [
        ('<!-- <meta itemprop="price" content="1.50"> --><script type="application/ld+json">{"@type":"Product","offers":{"price":"83.52","priceCurrency":"EUR"}}</script> In stock', (83.52, "EUR", True, "json_ld")),
        ('<span itemprop="price" content="12.50"></span> лв. sold out', (12.5, "BGN", False, "microdata")),
        ('<span itemprop="price" content="12.50"></span><span itemprop="price" content="13.50"></span><meta property="product:price:amount" content="9.99">', (9.99, None, None, "meta")),
        ("nothing here", (None, None, None, None)),
    ]
    rows = pricepages.page_prices(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "n long, html string")).orderBy("n").collect()
    assert [(r["price"], r["currency"], r["in_stock"], r["strategy"]) for r in rows] == [x for _, x in pages]
    maps = spark.createDataFrame([("s", "<urlset><url><loc> https://a.b/c </loc></url><url><loc>https://a.b/d</loc></url></urlset>")], "site string, xml string")
    assert [r["url"] for r in pricepages.sitemap_locations(maps).collect()] == ["https://a.b/c", "https://a.b/d"]
    pricepages.export_csv(spark.createDataFrame([("x", 1.5)], "name string, price double").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text().split() == ["name;price", "x;1,5"]


def test_robots(spark):
    urls = spark.createDataFrame([("h", "/a/b"), ("h", "/a"), ("h", "/c"), ("o", "/a")], "host string, path string")
    rules = spark.createDataFrame([("h", False, "/a"), ("h", True, "/a/b"), ("h", True, "/a/"), ("h", False, "/a/")], "host string, allow boolean, prefix string")
    assert {(r["host"], r["path"]): r["allowed"] for r in textjoin.robots_allowed(urls, rules).collect()} == {("h", "/a/b"): True, ("h", "/a"): False, ("h", "/c"): True, ("o", "/a"): True}


def test_units_of_all_kinds(spark):
    cases = [
        (212.0, "°F", "°c", 100.0), (1.0, "psi", "mbar", 68.9), (2.0, "к.с", "kw", 1.471), (36.0, "km/h", "м/с", 10.0), (1.5, "h", "мин", 90.0), (1.0, "kwh", "mah", 1000 / 0.0037),
        (3.0, "t", "kg", 3000.0), (2.0, "кв.м", "cm2", 20000.0), (5.0, "мл", "cm", 500.0), (1.0, "gsm", "rpm", None), (1.0, "parsec", "m", None),
    ]
    rows = spark.createDataFrame(cases, "v double, a string, b string, want double").withColumn("got", units.convert_unit(F.col("v"), F.col("a"), F.col("b")))
    assert all(r["got"] is None if r["want"] is None else abs(r["got"] - r["want"]) < 1e-3 * r["want"] for r in rows.collect())


def test_spellings_of_two_kinds(spark):
    cases = [("g", None, "mass", 0.016), ("g", "data", "data", 16.0), ("T", "data", "data", 16000.0), ("мл", "volume", "volume", 0.016), ("mm", "data", "length", 0.016)]
    rows = spark.createDataFrame(cases, "u string, h string, kind string, base double")
    for r in rows.withColumn("k", units.kind_of(F.col("u"), F.col("h"))).withColumn("b", units.to_base(F.lit(16.0), F.col("u"), F.col("h"))).collect():
        assert (r["k"], r["b"]) == (r["kind"], r["base"])


def test_quantities_are_written(spark):
    cases = [(12.0, "вата", "12 W"), (2.5, "mm2", "2.5 mm²"), (55.0, "zoll", '55"'), (0.33333, "л", "0.333 l"), (100.0, "°f", "100 °F"), (1.0, "parsec", None)]
    rows = spark.createDataFrame(cases, "v double, u string, want string").withColumn("got", units.formatted(F.col("v"), F.col("u")))
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_measures_in_folded_text(spark):
    found = values(spark, lambda x: F.to_json(units.measurements(F.lower(text.fold_homoglyphs(x)))), ["12 вата, 1,5 м и 20 м2 за 10 кг, 5 об/мин"], "string")[0]
    assert found == '[{"kind":"power","value":12.0},{"kind":"length","value":1.5},{"kind":"area","value":20.0},{"kind":"mass","value":10.0},{"kind":"rotation","value":5.0}]'

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import normalize
from tallyspark.operators import recovering
from tallyspark.sources import files, invoice_xml, transcripts
from tallyspark.streaming import transcripts as streaming

XML = """<rsm:CrossIndustryInvoice xmlns:rsm="a" xmlns:ram="b" xmlns:udt="c"><rsm:ExchangedDocument><ram:ID> RE-7 </ram:ID><ram:TypeCode>380</ram:TypeCode>
<ram:IssueDateTime><udt:DateTimeString format="102">20240229</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument>
<rsm:SupplyChainTradeTransaction><ram:ApplicableHeaderTradeAgreement><ram:SellerTradeParty><ram:Name></ram:Name><ram:PostalTradeAddress><ram:PostcodeCode>1</ram:PostcodeCode><ram:CityName>X</ram:CityName></ram:PostalTradeAddress></ram:SellerTradeParty></ram:ApplicableHeaderTradeAgreement>
<ram:ApplicableHeaderTradeSettlement><ram:ApplicableTradeTax><ram:RateApplicablePercent>19.00</ram:RateApplicablePercent></ram:ApplicableTradeTax><ram:ApplicableTradeTax><ram:RateApplicablePercent>7</ram:RateApplicablePercent></ram:ApplicableTradeTax>
<ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:GrandTotalAmount>12.345</ram:GrandTotalAmount><ram:TotalPrepaidAmount>0.00</ram:TotalPrepaidAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement></rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>"""


def test_invoice_xml(spark):
    df = spark.createDataFrame([(1, XML)], "doc_id long, xml string")
    got = {r.field_key: (r.gt_present, r.gt_norm) for r in invoice_xml.parse(df).collect()}
    assert len(got) == 34
    assert got["invoice_number"] == (True, "RE-7") and got["issue_date"] == (True, "2024-02-29") and got["document_type"] == (True, "invoice")
    assert got["seller_name"] == (True, "") and got["buyer_name"] == (False, None) and got["seller_address"] == (True, "1, X")
    assert got["tax_rate"] == (True, None) and got["grand_total_amount"] == (True, "12.34") and got["prepaid_amount"] == (False, None)
    rows = invoice_xml.parse_rows(df, "vat_breakdown").filter("field_key = 'rate_percent'").orderBy("j").collect()
    assert [r.gt_norm for r in rows] == ["19", "7"]


TAX = "<ram:ApplicableTradeTax>{}</ram:ApplicableTradeTax>"
ROWS = """<rsm:{root} xmlns:rsm="a" xmlns:ram="b"><rsm:{deal}><ram:{part}>{rows}</ram:{part}></rsm:{deal}></rsm:{root}>"""


def test_a_row_that_lacks_a_cell_keeps_the_others(spark):
    from tallyspark.plans.registry import OLDER_NAMES

    names = dict(root="CrossIndustryInvoice", deal="SupplyChainTradeTransaction", part="ApplicableHeaderTradeSettlement")
    inner = ["<ram:RateApplicablePercent>19.00</ram:RateApplicablePercent><ram:CategoryCode>S</ram:CategoryCode>", "<ram:CategoryCode>Z</ram:CategoryCode>", "<ram:RateApplicablePercent/><ram:CategoryCode>E</ram:CategoryCode>"]
    new = ROWS.format(**names, rows="".join(map(TAX.format, inner)))
    old = ROWS.format(**{k: OLDER_NAMES.get(v, v) for k, v in names.items()}, rows="".join(TAX.format(x.replace("RateApplicablePercent", OLDER_NAMES.get("RateApplicablePercent", "RateApplicablePercent"))) for x in inner))
    df = spark.createDataFrame([(1, new), (2, old), (3, "<x/>"), (4, None)], "doc_id long, xml string")
    got = {(r.doc_id, r.j): (r.gt_present, r.gt_norm) for r in invoice_xml.parse_rows(df, "vat_breakdown").filter("field_key = 'rate_percent'").collect()}
    assert got == {(d, j): v for d in (1, 2) for j, v in enumerate([(True, "19"), (False, None), (True, "")])}


def test_text_of_readers(spark):
    from tallyspark.functions import text as T

    values = {"[Name fehlt]": None, "None such GmbH": "None such GmbH", "** 471102": "471102", "/Leistungsempfänger": "Leistungsempfänger", ":": None, "N/A": None, " `X`. ": "X`"}
    df = spark.createDataFrame(list(values.items()), "raw string, want string")
    assert not df.filter(~T.clean_value(F.col("raw")).eqNullSafe(F.col("want"))).collect()
    page = "**Steuernummer:** 201/113\nRechnungsnummer:\nKundennummer 5\n* **Datum**: 1.2.2024\nNr. A-7 vom 03.04.2024\n## Käufer\nName: ACME\nOrt: X\n\nName: Other"
    one = spark.createDataFrame([(page,)], "t string").select(
        *(T.labelled(F.col("t"), x).alias(x) for x in ("Steuernummer", "Rechnungsnummer", "Kundennummer", "Datum")), T.named_in_section(F.col("t"), "Käufer").alias("buyer"), *T.cross_references(F.col("t"))
    ).first()
    assert list(one) == ["201/113", None, "5", "1.2.2024", "ACME", "A-7", "03.04.2024"]
    block = "\n".join(["a", "b", "c"] * 4 + ["d", "e", "e", "f", "f", "f"])
    cells = "<fcel>Summe:<fcel>5<nl><fcel>a<ecel><fcel>b<srow>c<nl><ecel><nl>"
    marks = "<doctag><text><loc_4>x</text>\n<b>y</b></doctag>"
    got = spark.createDataFrame([(block, cells, marks)], "b string, c string, m string").select(T.collapse_blocks(F.col("b")), T.collapse_line_runs(F.col("b")), T.table_rows(F.col("c")), T.strip_markup(F.col("m"))).first()
    assert got[0] == "a\nb\nc\nd\ne\ne\nf\nf\nf" and got[1].endswith("d\ne\ne\nf")
    assert got[2] == "Summe: 5\na b c" and got[3] == "x\n<b>y</b>"


def test_printed_values(spark):
    cases = {
        "MONEY": {"529,87": "529.87", "1.234,56": "1234.56", "1,234.56": "1234.56", "€529,87": "529.87", "EUR 529,87": "529.87", "1.234": "1.23", "0.125": "0.12", "abc": None, "": None},
        "DATE": {"2018-03-05": "2018-03-05", "05.03.2018": "2018-03-05", "5.3.2018": "2018-03-05", "05. März 2018": "2018-03-05", "05/03/2018": "2018-03-05", "30.02.2023": None, "March 5, 2018": None},
        "RATE": {"19": "19", "19.0": "19", "19,00": "19", "19 %": "19", "7,50 %": "7.5", "0.00": "0", "190": "190"},
        "CODE": {"DE 123 456 789": "DE123456789", "RE 12": "RE12", "Ab 12": "Ab 12"},
        "vat_category": {"S": "S", "ae": "AE", "Umsatzsteuer (S)": "S", "innergemeinschaftliche Lieferung": "K", "steuerfrei": "E", "foo": "foo"},
        "invoice_number": {"Nr. 471102": "471102", "Rechnung Nr. 471102": "471102", "NR-2024-001": "NR-2024-001"},
        "unsigned_money": {"0,00": None, "-50,00": "50.00"},
        "optional_money": {"-0,02": "-0.02"},
        "article_id": {"PFA5 4000001234578 (GTIN)": "PFA5", "KR3M4012345001235(GTIN)": "KR3M", "TB100A4": "TB100A4"},
    }
    rows = [(rule, raw, want) for rule, pairs in cases.items() for raw, want in pairs.items()]
    df = spark.createDataFrame(rows, "rule string, raw string, want string").withColumn("got", normalize.apply_rule(F.col("rule"), F.col("raw")))
    wrong = df.filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not wrong


def test_json_recovery():
    cases = {'{"a":1,}': {"a": 1}, 'x {"a":"}"} y': {"a": "}"}, '[{"a":1}]': None, '{"a":1}{"b":2}': {"a": 1}, '{"r":[{"x":"1" ] }': {"r": [{"x": "1"}]}, '{"a":[1,2': None, '{"a": "b}': None, None: None}
    import json

    for text, want in cases.items():
        got = recovering.recover_object(text)
        assert (json.loads(got) if got else None) == want, text


def test_transcripts_batch_and_stream(spark, tmp_path):
    text = "# Model: m/1\n# Invoice: inv\n\n===== PAGE 1 =====\n one \n===== PAGE 2 =====\n\n===== PAGE 3 =====\nthree\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(text)
    (tmp_path / "in/b.txt").write_text("no header")
    got = {r.model_id: r for r in transcripts.read(spark, str(tmp_path / "in")).collect()}
    assert got["m/1"].pages == ["one", "three"] and got["m/1"].invoice == "inv" and got[None].error == "no model"
    again = transcripts.parse(transcripts.render(spark.createDataFrame([("m", "i", ["p", "q"])], "model_id string, invoice string, pages array<string>"))).first()
    assert again.pages == ["p", "q"] and again.model_id == "m"
    stream = streaming.read_stream(spark, str(tmp_path / "in"))
    streaming.append_cells(stream, lambda b: b.select("model_id", F.size("pages").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.model_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).filter("model_id IS NOT NULL").collect()} == {("m/1", 2)}


def test_files(spark, tmp_path):
    for name in ("a.pdf", "a.cii.xml", "b.pdf", "README.md"):
        (tmp_path / name).write_text(name)
    found = files.walk(spark, str(tmp_path))
    assert {(r.stem, r.extension) for r in found.collect()} == {("a", "pdf"), ("a", "xml"), ("b", "pdf")}
    assert {(r.flavor, r.second, r.nested) for r in found.collect()} == {("(root)", "(none)", "")}
    (tmp_path / "v2/de/x/y").mkdir(parents=True)
    (tmp_path / "v2/de/x/y/c.pdf").write_text("c")
    assert [(r.flavor, r.second, r.nested) for r in files.walk(spark, str(tmp_path / "")).filter("stem = 'c'").collect()] == [("v2", "de", "x/y")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/README.md").write_text("x")
    with pytest.raises(ValueError):
        files.walk(spark, str(tmp_path / "none"))
    assert {(r.stem, r.xml_path is None) for r in files.paired(found, "pdf", "xml").collect()} == {("a", False), ("b", True)}

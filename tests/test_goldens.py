"""Inputs with known results, and the audit against a plain fold over rows."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from daybook.functions import entities, scalars
from daybook.operators import balance, ledgers, masters, segment, statements, usage, vouchers


def _each(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    got = _each(spark, scalars.normalize_date, ["01/04/2026", "15-09-2025", "02.05.2024", "01-Apr-2026", "12 Oct 2025", "2026-04-01", "no date"])
    assert [d and d.isoformat() for d in got] == ["2026-04-01", "2025-09-15", "2024-05-02", "2026-04-01", "2025-10-12", "2026-04-01", None]


def test_amounts(spark):
    got = _each(spark, scalars.normalize_amount, ["5,000", "₹5,000.50", "1,23,456.75", "Rs. 350.00 Cr", "(450.00)", ""])
    assert got == [Decimal(x) for x in ("5000.00", "5000.50", "123456.75", "350.00", "-450.00", "0.00")]


def test_narrations_and_references(spark):
    assert _each(spark, scalars.clean_narration, ["UPI/ABC TRADERS/\n INV NO 12345/\n   PAYMENT FOR GOODS"]) == ["UPI/ABC TRADERS/ INV NO 12345/ PAYMENT FOR GOODS"]
    assert _each(spark, scalars.extract_reference, ["UPI/446130236270/P2V/9418250639@ybl/RAKESH", "NEFT/N1234567890ABC/PAYMENT"]) == ["446130236270", "N1234567890ABC"]
    quiet = _each(spark, entities.without_noise, ["UPI -1 LAT/123456/Party Name LATENCY CTO610"])[0]
    assert "UPI" in quiet and not any(x in quiet for x in ("-1 LAT", "LATENCY", "CTO610"))
    assert _each(spark, lambda c: entities.instrument_number(c, F.lit(None).cast("string")), ["IZE 689744 Paid To VENDOR"]) == ["689744"]
    assert _each(spark, scalars.sanitize_xml, ["<STATE>&#4; Any</STATE><NAME>Test&#0;&#8;&#31; Name</NAME>"]) == ["<STATE> Any</STATE><NAME>Test Name</NAME>"]


CHARGES = ["SMS ALERT CHARGES", "A/C MAINTENANCE CHARGES", "BANK CHARGES", "SERVICE CHARGES", "NEFT CHARGES", "CONSOLIDATED CHG", "DEBIT CARD CHARGES"]


def test_parties_and_cash(spark):
    debit, credit = (lambda c: entities.party(c, F.lit(True))), (lambda c: entities.party(c, F.lit(False)))
    assert all(tuple(p) == ("Bank Charges", "BANK_CHARGES") for p in _each(spark, debit, CHARGES))
    assert _each(spark, credit, ["INT.COLL ON SAVINGS ACCOUNT"])[0]["name"] == "Bank Interest Income"
    assert _each(spark, debit, ["INT.PD ON OD ACCOUNT"])[0]["name"] == "Bank Interest Expense"
    assert tuple(_each(spark, debit, ["RTGS OUT : PUNBR52024 : BABA BALAK NATH"])[0]) == ("BABA BALAK NATH", "RTGS")
    assert _each(spark, lambda c: entities.cash_type(c, F.lit(False)), ["CASH DEPOSIT BY SELF"]) == ["CASH_DEPOSIT"]
    assert _each(spark, lambda c: entities.cash_type(c, F.lit(True)), ["ATM CASH WITHDRAWAL", "CASH WITHDRAWAL", "CASH WDL", "ATM WDL", "SELF CASH", "SELF WDL", "TO CASH"]) == ["CASH_WITHDRAWAL"] * 7
    # The deposit wordings are tried first, and one of them stands in this.
    assert _each(spark, lambda c: entities.cash_type(c, F.lit(True)), ["WITHDRAWAL BY CASH"]) == ["CASH_DEPOSIT"]


TX = "stmt_id long, row_index int, tx_date date, debit decimal(15,2), credit decimal(15,2), balance decimal(15,2), opening decimal(15,2)"


def _audited(spark, statements_):
    rows = [(i, n + 1, None, *(None if x is None else Decimal(str(x)) for x in row), None if opening is None else Decimal(str(opening))) for i, (opening, given) in enumerate(statements_) for n, row in enumerate(given)]
    out = balance.audit(spark.createDataFrame(rows, TX))
    found = {}
    for r in out.orderBy("stmt_id", "row_index").collect():
        found.setdefault(r["stmt_id"], []).append(r)
    return out, [found[i] for i in range(len(statements_))]


def test_audit_goldens(spark):
    cases = [
        (10000, [(1000, 0, 9000), (0, 500, 9500), (200, 0, 9300)]), (10000, [(1000, 0, 9000.50)]), (None, [(1000, 0, None)]), (10000, [(1000, 0, 9000), (0, 500, 9500)]),
        (50000, [(5000, 0, 45000), (0, 10000, 55000)]), (50000, [(5000, 0, 40000)]), (10000, [(1000, 0, 11000)]),
    ]
    out, rows = _audited(spark, cases)
    status = [[r["validation_status"] for r in s] for s in rows]
    assert status == [["VALID"] * 3, ["WARNING"], ["VALID"], ["VALID"] * 2, ["VALID"] * 2, ["ERROR"], ["VALID"]]
    assert rows[6][0]["credit"] == 1000  # an entry on the wrong side is swapped
    confidence = {r["stmt_id"]: r["confidence_score"] for r in balance.statement_summary(out).collect()}
    assert confidence[3] == confidence[4] == 100.0 and confidence[5] < 100


def _fold(opening, rows):
    """The audit row by row: (expected balance, status, swapped)."""
    current, out = opening, []
    if current is None and rows:
        d, c, b = rows[0]
        current = None if b is None else b - c if c > 0 else b + d if d > 0 else b
    for d, c, b in rows:
        expected = None if current is None else current + c - d
        status, swapped = "VALID", False
        if d == 0 and c == 0:
            status = "WARNING"
        elif b is not None and expected is not None:
            if abs(expected - b) <= Decimal("0.01"):
                pass
            elif abs(expected - b) <= Decimal("1.00"):
                status = "WARNING"
            elif abs(current - c + d - b) <= Decimal("1.00"):
                swapped = True
            else:
                status = "ERROR"
        out.append((expected, status, swapped))
        current = b if b is not None else expected
    return out


def test_audit_is_a_fold(spark):
    rng = random.Random(9)
    cases = []
    for _ in range(60):
        now, given = Decimal(rng.randint(0, 5000)), []
        opening = now if rng.random() < 0.6 else None
        for _ in range(rng.randint(1, 12)):
            amount = Decimal(rng.randint(0, 3000)) / 10
            d, c = (amount, Decimal(0)) if rng.random() < 0.5 else (Decimal(0), amount)
            now += c - d
            kind = rng.random()
            if kind < 0.15:
                d, c = c, d
            printed = None if 0.15 < kind < 0.4 else now + (Decimal("0.5") if kind > 0.9 else Decimal(40) if kind > 0.8 else 0)
            given.append((d, c, printed))
        cases.append((opening, given))
    _, rows = _audited(spark, cases)
    for (opening, given), got in zip(cases, rows, strict=True):
        want = _fold(opening, given)
        assert [(r["expected_balance"], r["validation_status"], r["outcome"] == "SWAPPED") for r in got] == want


CHART = [("ABC TRADERS", 0), ("Tata Play Direct", 1), ("HIMALAYAN ADVENTURES", 2)]


@pytest.mark.parametrize(
    "names, rules, narration, ledger, least",
    [
        ([], [], "RANDOM OBSCURE UNKNOWN PAYEE 9988", "Suspense", 0), (["ABC TRADERS"], [], "UPI/446295445740/P2M/pay@okaxis/ABC TRADERS", "ABC TRADERS", 95),
        (["Tata Play Direct"], [], "UPI/446295445740/P2M/tataplay@ybl/TATA PLAY DIRECT", "Tata Play Direct", 95), (["ABC TRADERS PVT LTD"], [], "NEFT/N123456/ABC TRADERS", "ABC TRADERS PVT LTD", 80),
        (["HIMALAYAN ADVENTURES"], [], "IMPS/998877/DELHI MOTORS", "Suspense", 0), (["X"], [("PATANJALI STORE", "Patanjali Ayurved A/C")], "UPI/PATANJALI STORE/23490", "Patanjali Ayurved A/C", 100),
    ],
)
def test_matching_goldens(spark, names, rules, narration, ledger, least):
    tx = spark.createDataFrame([(1, 1, narration, Decimal(5), Decimal(0))], "stmt_id long, row_index int, narration string, debit decimal(15,2), credit decimal(15,2)")
    chart = spark.createDataFrame([(n, i, None, None) for i, n in enumerate(names)], "name string, ord int, gstin string, alias string")
    saved = spark.createDataFrame([(p, to, i) for i, (p, to) in enumerate(rules)], "pattern string, ledger string, ord int")
    got = ledgers.match(tx, chart, saved).first()
    assert got["ledger_name"] == ledger and got["mapping_confidence"] >= least


def test_voucher_types(spark):
    rows = [("CASH DEPOSIT BY SELF", 0, 5500), ("INTERNAL TRANSFER TO SAVINGS", 5500, 0), ("UPI/1/ABC", 3928, 0), ("NEFT/2/XYZ", 0, 3500)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, d int, c int")
    got = [r["t"] for r in df.select("i", vouchers.voucher_type(F.col("n"), F.col("d"), F.col("c")).alias("t")).orderBy("i").collect()]
    assert got == ["Contra", "Contra", "Payment", "Receipt"]


def test_quota(spark):
    df = spark.createDataFrame([(103, 50, 0), (103, 20, 100)], "p int, f int, b int")
    got = [tuple(r["a"]) for r in df.select(usage.allocation(F.col("p"), F.col("f"), F.col("b")).alias("a")).collect()]
    assert got == [(50, 53, 50, 0), (103, 0, 20, 83)]


def test_masters(spark):
    xml = '<ENVELOPE><LEDGER NAME="ABC TRADERS"><PARENT>Sundry Debtors</PARENT></LEDGER><LEDGER NAME="HDFC"><PARENT>Bank Accounts</PARENT><OPENINGBALANCE>1,250.50</OPENINGBALANCE></LEDGER></ENVELOPE>'
    page = "<script>x</script><table><tr><th>Particulars</th></tr><tr><td>1</td><td>ABC TRADERS</td><td>Sundry Debtors</td></tr><tr><td>XYZ</td><td>12,000.00</td></tr></table>"
    one = lambda x: spark.createDataFrame([("f", x)], "file string, content string")
    told = lambda df: [(r["name"], r["grp"]) for r in df.orderBy("ord").collect()]
    assert told(masters.xml_masters(one(xml))) == [("ABC TRADERS", "Sundry Debtors"), ("HDFC", "Bank Accounts")]
    assert masters.xml_masters(one(xml)).where("name = 'HDFC'").first()["opening_balance"] == Decimal("1250.50")
    assert told(masters.xml_masters(one("<X><MASTERNAME> Flat  One </MASTERNAME></X>"))) == [("Flat One", "Primary")]
    assert told(masters.html_ledgers(one(page))) == [("ABC TRADERS", "Sundry Debtors"), ("XYZ", "Primary")]
    assert told(masters.json_ledgers(one('[{"name": "ABC TRADERS", "group": "Sundry Debtors"}, "XYZ CORP", {"title": " Q  R "}]'))) == [("ABC TRADERS", "Sundry Debtors"), ("XYZ CORP", "Primary"), ("Q R", "Primary")]
    assert told(masters.json_ledgers(one('{"A": "G", "B": {"group": "H"}, "C": {}}'))) == [("A", "G"), ("B", "H"), ("C", "Primary")]
    assert masters.json_ledgers(one(None)).count() == masters.html_ledgers(one("")).count() == masters.xml_masters(one(None)).count() == 0


def test_filled_balances(spark):
    rows = [(1, 1, 10, 0, None, 100), (1, 2, 0, 5, 95, 100), (1, 3, 1, 0, 90, 100), (1, 4, 1, 0, None, 100), (2, 1, 5, 0, None, None), (2, 2, 5, 0, 40, None), (2, 3, 0, 1, None, None)]
    tx = spark.createDataFrame([(s, i, None, Decimal(d), Decimal(c), None if b is None else Decimal(b), None if o is None else Decimal(o)) for s, i, d, c, b, o in rows], TX)
    got = [(r["balance"], r["fill_status"]) for r in statements.filled_balances(tx).orderBy("stmt_id", "row_index").collect()]
    assert got == [(90, "VALID"), (95, "VALID"), (90, "WARNING"), (89, "VALID"), (None, "VALID"), (40, "VALID"), (41, "VALID")]


def test_records_of_a_page(spark):
    page = ["Statement of Account", "DATE PARTICULARS WITHDRAWAL DEPOSIT BALANCE", "01/04/2024 APY CONTRI JUNE 228.00 46,072.00", "02/04/2024 UPI/446130236270/CR/RAKESH 3,500.00 49,572.00", "more text", "03/04/2024 CASH DEPOSIT 5,500.00 55,072.00", "STATEMENT SUMMARY"]
    lines = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(page)], "doc_id long, page_number int, line_no int, line string")
    got = [(r["debit"], r["credit"], r["balance"]) for r in statements.of_text(lines).orderBy("row_index").collect()]
    assert got == [(Decimal("228.00"), 0, Decimal("46072.00")), (0, Decimal("3500.00"), Decimal("49572.00")), (0, Decimal("5500.00"), Decimal("55072.00"))]
    assert segment.parsed_records(segment.records(lines)).where("record = 2").first()["narration"].endswith("more text")


def test_character_references(spark):
    from daybook.functions.scalars import without_references

    told = {"A &amp; B": "A & B", "&amp;lt;": "&lt;", "&#8377;5 &#x20B9;6 &#X41;": "₹5 ₹6 A", "&#128512;": "😀", "&quot;x&apos;&nbsp;y": "\"x' y", "& &; &x &unknown; &#; &#0; &#xD800; &#1114112;": "& &; &x &unknown; &#; &#0; &#xD800; &#1114112;", "": "", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in told] + [(None,)], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", without_references(df["t"]).alias("x")).collect()}
    assert got == {**told, None: None}

"""Detection against a plain search of every pattern in every page, and how many patterns are tried."""

import random
import re

import pytest

from daybook.operators import detect
from daybook.operators.detect import Signature
from daybook.plans.detect_plans import signature_rows


def plain(page, head, s):
    score, ifsc, account = 0.0, None, None
    find = lambda p, t: re.search(p, t, re.I)
    score += 70 * any(find(p, head) for p in s.header_names)
    if s.ifsc_prefix:
        label = find(r"(?:IFS\s*Code|IFSC|RTGS/NEFT\s*IFSC)[\s:-]+([A-Z0-9]+)", head)
        near = find(rf"\b({s.ifsc_prefix}[0-9A-Z]{{6}})\b", head)
        if label and label[1].upper().startswith(s.ifsc_prefix):
            score, ifsc = score + 65, label[1].upper()
        elif near:
            score, ifsc = score + 50, near[1].upper()
    score += 35 * any(d.lower() in head.lower() for d in s.domains)
    score += 25 * sum(bool(find(m, head)) for m in s.header_markers)
    for p in s.account_patterns:
        m = find(p, head) or find(p, page)
        if m:
            account, score = m[1], score + 25
            break
    return score + 30 * any(find(c, page) for c in s.column_patterns), account, ifsc


@pytest.mark.parametrize("seed", range(3))
def test_scores_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    signatures = detect.signatures_from(signature_rows()) + (Signature("Odd", "odd", (r"\bOD{1,2}\b", "x|y bank", r"(?:No\.?|Nr)\s+Bank"), None, ("o.in",), (r".?arker", "Mar?ker", "ab")),)
    bits = ["State Bank of India", "ONLINE", "SBIN ONLINE", "hdfcbank.com", "IFSC: PUNB0123456", "Branch: uco", "UCBA0999999", "Account No: 12345678901", "A/c 1234567890123456", "Drawing Power :", "State  Customer Id:", "marker", "maker", "ODD", "y bank", "Nr Bank", "é ab", "net.kotak.example", "sbi"]
    pages = []
    for i in range(60):
        head = "\n".join(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 5)))
        pages.append((i, head + rng.choice(["", "\nTxn Date Value Date Description Debit Credit Balance\nA/c No 123456789", "\n01/04/2024 Date Particulars"])))
    df = spark.createDataFrame([*pages, (99, ""), (98, "ab")], "doc_id long, first_page string")
    heads = {r["doc_id"]: r["h"] for r in df.select("doc_id", detect.header_text(df["first_page"]).alias("h")).collect()}
    got = {(r["doc_id"], r["ord"]): (r["score"], r["account"], r["ifsc"]) for r in detect.scores(df, signatures).collect()}
    want = {(i, k): told for i, page in [*pages, (99, ""), (98, "ab")] for k, s in enumerate(signatures) if (told := plain(page, heads[i] or "", s))[0] > 0}
    assert got == want and len(want) > 50


def test_what_patterns_begin_with():
    told = {
        r"\bSTATE\s+BANK\b": ("STATE",), r"(?:Account|A/c)\s*": ("Account", "A/c"), r"CIF\s+No\.?\s*:": ("CIF",), "www\\.bank": ("www.bank",), "Balances?": ("Balance",),
        "Bala*": ("Bal",), "ab": None, "x|yyy": None, "(?:a|bcd)x": None, ".+Balance": None, "(?:abc|def)?x": None, "[A-Z]bc": None, "abc[x|y]": ("abc",), "(a|b)": None,
    }
    assert {p: detect.begins_with(p) for p in told} == told


def test_more_signatures_do_not_mean_more_work(spark):
    some = detect.signatures_from(signature_rows())
    more = some + tuple(detect.signature(f"Qx{i} Bank", f"QX{i:02}", f"zq{i}.example", "p") for i in range(1000))
    df = spark.createDataFrame([(i, f"State Bank of India\nwww.sbi.co.in\nAccount No: {i:011}\nIFSC: SBIN0000001") for i in range(20)], "doc_id long, first_page string")
    tried = [sum(len(r["tried"]) for r in detect.with_matches(df, detect.indexed(x)).collect()) for x in (some, more)]
    patterns = [len(detect.indexed(x).patterns) for x in (some, more)]
    assert tried[0] == tried[1] and tried[0] < 20 * 60 and patterns[1] > 10 * patterns[0]

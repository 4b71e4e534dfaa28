import hashlib
import random
import re

import pytest

from markbook.llm import pii
from tests.llm.frames import frame, odd_rows

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, hit):
    digits = re.sub(r"[^0-9]", "", hit)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in hit.split(".")) if kind == "ip" else False,
        "card": 14 <= len(digits) <= 19 and luhn(digits or "0"),
        "phone": 10 <= len(digits) <= 15,
    }[kind]


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            if good(kind, m[0]):
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(found))


def random_text(seed):
    draw = random.Random(seed)
    parts = ["a@b.co", "x_y@d.e_f@g.h", "..@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
             "4111111111111111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+12", "+49 30 1234567 8", " ", "é", "😀",
             "@", ".", "-", "+", "7", "42", "word", "\n", "a.b@c.d.e", "0000000000000000", "+1+1234567890"]
    return "".join(draw.choice(parts) for _ in range(draw.randrange(1, 40)))


def test_base_spans_match_brute_force(spark):
    rows = [(i, random_text(i)) for i in range(300)] + odd_rows()
    got = pii.digest(pii.find_personal_data(frame(spark, rows))).collect()
    base = [",".join(s for s in r["spans"].split(",") if s and not s.startswith("iban")) for r in got]
    want = sorted(((i, brute(t)) for i, t in rows), key=repr)
    assert sorted(zip([r["doc_id"] for r in got], base), key=repr) == want
    for r, b in zip(got, base):
        assert r["base_sha256"] == hashlib.sha256(b.encode()).hexdigest()
        for kind in BASE:
            assert r[f"n_{kind}"] == b.count(f"{kind}:")


def test_checksums_and_context(spark):
    rows = [
        (1, "my card: 4111111111111111 and GB82WEST12345698765432"),
        (2, "4111111111111111 GB82WEST12345698765433"),
        (3, "bank account GB82WEST12345698765432"),
    ]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(frame(spark, rows))).collect()}
    assert (got[1]["spans"], got[1]["scores"]) == ("card:9:25,iban:30:52", "80,80")
    assert (got[2]["spans"], got[2]["scores"]) == ("card:0:16", "60")
    assert (got[3]["spans"], got[3]["scores"]) == ("iban:13:35", "100")


@pytest.mark.parametrize("text", ["1 " * 200_000, "a." * 200_000, "1.1." * 100_000, "a@b.c " * 3_000, "+1(" * 100_000])
def test_long_runs_are_no_trouble(spark, text):
    row = pii.digest(pii.find_personal_data(frame(spark, [(1, text)]))).first()
    assert row["n_email"] == (3_000 if "@" in text else 0)


def test_empty_table_and_native_plan(spark):
    got = pii.digest(pii.find_personal_data(frame(spark, [])))
    assert got.count() == 0
    plan = got._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "ArrowEval"))

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd, even = digits[::-1][::2], digits[::-1][1::2]
            luhn = (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0
            good = {"email": True, "ip": all(int("0" + p.lstrip("0")[:4]) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE]


SAMPLES = ["a@b@c.com-x@y.com x.y+z@q-1.co.uk..", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000000001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (269) 555-3296 4132524132264652876", "+49 170 1234567+1 555 123 4567", "@a.b é@a.b", "", "1" * 3000 + "@" * 50]


def test_samples():
    for x in SAMPLES:
        assert base(x) == plain(x), x


def test_very_long_runs():
    runs = [c * 2_000 for c in "0123456789.@+- ()a_"] + ["0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 9000 + "4", "1." * 2000, "1 " * 2000, "1-" * 2000, "+1" * 2000, "a@" * 2000, "+1" + "(" * 2000 + "2", "a@" + "b." * 2000 + "c"]
    for a in runs:
        assert base(a) == plain(a)
        assert base(f"x {a} 1.2.3.4") == plain(f"x {a} 1.2.3.4")
    for cue in ("password=", "iban ", "://", "account number: "):
        pii.spans(cue * 3000 + "0" * 20_000)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="019.-+ ()@aé", max_size=60))
def test_like_plain_patterns(text):
    assert base(text) == plain(text)


def test_added_kinds():
    kinds = [s[0] for s in pii.spans('see https://x.example/a?b=1 password=531ccd051a92 token = "ce0cc631f6559e74" IBAN: GB82WEST12345698765432 SSN 123-45-6789')]
    assert kinds == ["url", "secret", "secret", "account", "account"]


def test_report_and_redact(spark):
    rows = [(1, SAMPLES[0]), (1, SAMPLES[0]), (2, None), (3, ""), (None, "a@b.co"), (4, "x " * 100_000 + "+1 555 123 4567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = pii.report(docs).collect()
    assert len(got) == 6
    for doc_id, text in rows:
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in plain(text or ""))
        assert any(r["doc_id"] == doc_id and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() for r in got)
    assert {r["text"] for r in pii.redact(docs).where("doc_id = 1 or doc_id = 2").collect()} == {None, "a@[EMAIL]@y.com [EMAIL].."}
    assert pii.report(docs.limit(0)).count() == 0

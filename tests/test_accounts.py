import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from riskweave.functions.accounts import Pseudonymiser, account_reject_reason, normalize_account

KEY = bytes(range(100, 132))
GOOD = {
    "ACC-999": "ACC-999",
    " acc-999 ": "ACC-999",
    "ACC-999\n": "ACC-999",
    "a b\tc\u2003d\u30001": "ABCD1",
    "A" * 34: "A" * 34,
}
BAD = [
    "", "AC", "ACC_999", "ACC/999", "A" * 40, "ACC-999\0", "ACC;999",
    "ACC-\u0130", "STRA\u00dfE", "\ufb00ABC", "\u017fABC", "ACC-\u200b99",
]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "account string")


def test_normalises_formatting(spark):
    rows = frame(spark, GOOD).select("account", normalize_account(F.col("account")).alias("n"))
    assert {r.account: r.n for r in rows.collect()} == GOOD


def test_rejects_malformed_and_lookalikes(spark):
    raw = F.col("account")
    rows = frame(spark, [*BAD, None]).select(
        "account", normalize_account(raw).alias("n"), account_reject_reason(raw).alias("why")
    ).collect()
    assert all(r.n is None and r.why for r in rows)
    why = {r.account: r.why for r in rows}
    assert why[None] == "missing"
    assert why["STRA\u00dfE"] == why["\u017fABC"] == "non_ascii"
    assert why["ACC_999"] == "malformed"


def test_whitespace_set_equals_python(spark):
    text = [f"A{chr(c)}BCD" for c in range(1, 0x3002) if not 0xD800 <= c < 0xE000]
    rows = frame(spark, text).select("account", normalize_account(F.col("account")).alias("n")).collect()
    for r in rows:
        bare = "".join(r.account.split())
        ok = bare.isascii() and all(c.isalnum() or c == "-" for c in bare) and len(bare) >= 4
        assert r.n == (bare.upper() if ok else None), repr(r.account)


@pytest.mark.parametrize("key", [KEY, b"k" * 64, b"long" * 40])
def test_risk_id_is_hmac(spark, key):
    ids = Pseudonymiser.from_key(spark, key).with_risk_id(frame(spark, GOOD)).collect()
    for r in ids:
        want = hmac.new(key, GOOD[r.account].encode(), hashlib.sha256).hexdigest()
        assert r.risk_id == want


def test_short_key_is_refused(spark):
    with pytest.raises(ValueError):
        Pseudonymiser.from_key(spark, b"short" * 6)


def test_key_is_not_in_the_plan(spark, capsys):
    df = Pseudonymiser.from_key(spark, KEY).with_risk_id(frame(spark, GOOD))
    df.collect()
    df.explain(True)
    text = capsys.readouterr().out.lower()
    block = KEY.ljust(64, b"\0")
    for pad in (0x36, 0x5C):
        data = bytes(b ^ pad for b in block)
        assert data.hex() not in text
        assert str(list(data))[1:30] not in text
    assert KEY.hex() not in text

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from shelfscan.llm import pseudonyms
from tests.llm.conftest import documents

KEY = "test"


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def iban_ok(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def masked(spark, texts: list, key: str = KEY) -> list:
    df = documents(spark, *enumerate(texts))
    return [r["text"] for r in pseudonyms.masked(df, key).orderBy("doc_id").collect()]


def shape(value: str) -> str:
    return re.sub(r"[0-9]", "9", value)


@pytest.mark.parametrize(("high", "low"), [(1, 1), (1, 7), (5, 3), (13, 13), (2, 30)])
def test_feistel_is_a_permutation(spark, high, low):
    df = spark.range(high * low).select((F.col("id") / low).cast("long").alias("a"), (F.col("id") % low).alias("b"))
    size = lambda n: F.lit(n).cast("bigint")
    got = df.select(pseudonyms.feistel(F.col("a"), F.col("b"), size(high), size(low), KEY, F.lit("t")).alias("p")).collect()
    assert {(r["p"]["high"], r["p"]["low"]) for r in got} == {(a, b) for a in range(high) for b in range(low)}


def test_digit_strings_of_a_length_are_permuted(spark):
    for n in (2, 3, 4):
        df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        got = [r[0] for r in df.select(pseudonyms.permuted_digits(F.col("d"), KEY, "t")).collect()]
        assert len(set(got)) == 10**n and {len(x) for x in got} == {n}


def test_all_dates_are_permuted(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(d) for d in range(0, pseudonyms.DAYS)]
    df = spark.createDataFrame([(str(d),) for d in days], "v string").repartition(8)
    got = {r[0] for r in df.select(pseudonyms._date(F.col("v"), KEY)).collect()}
    assert got == {str(d) for d in days}


def test_month_first_dates_are_permuted_among_themselves(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(d) for d in range(pseudonyms.DAYS)]
    late = {f"{d:%m/%d}/{d.year}" for d in days if d.day > 12}
    assert len(late) == pseudonyms.LATE_DAYS
    df = spark.createDataFrame([(v,) for v in late], "v string").repartition(8)
    assert {r[0] for r in df.select(pseudonyms._date(F.col("v"), KEY)).collect()} == late


def test_dates_month_first_and_with_dashes(spark):
    got = masked(spark, ["born 12/25/1985.", "born 25-12-1985.", "born 12-25-1985.", "25.12.1985", "13/32/1985", "02-30-1985", "25-12/1985"])
    for text, form in zip(got[:3], ("%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y"), strict=True):
        new = text.removeprefix("born ").removesuffix(".")
        assert "1985" not in new or new[:5] not in ("12/25", "25-12", "12-25")
        assert datetime.datetime.strptime(new, form)
    assert got[0].replace("/", "-") == got[2] and got[1] == f"born {got[3].replace('.', '-')}."
    assert got[4:] == ["13/32/1985", "02-30-1985", "25-12/1985"]


@pytest.mark.parametrize("n", [8, 64, 65, 512, 513, 700, 100_000])
def test_secrets_of_any_length(spark, n):
    secret = ("Zz" + "yX9_" * n)[:n]
    (new,) = masked(spark, [f'token = "{secret}" end'])
    assert re.fullmatch(rf'token = "[0-9a-f]{{{n}}}" end', new) if n < 60_000 else set(new[9:-5]) <= set("0123456789abcdef")
    assert len(new) == n + 14


def test_secrets_in_json_and_aligned(spark):
    texts = ['{"password": "Zzyyxx_Zz", "a": 1}', "password      =      Zzyyxx_Zz", "'api_key':'Zzyyxx_Zz'", '"token"\t:\t\t\t\t"Zzyyxx_Zz"']
    got = masked(spark, texts)
    for text, new in zip(texts, got, strict=True):
        before, after = text.split("Zzyyxx_Zz")
        assert re.fullmatch(re.escape(before) + "[0-9a-f]{9}" + re.escape(after), new)


VALID = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "3782 822463 10005", "4222222222222"],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947"],
    "ssn": ["123-45-6789", "899-99-9999", "665-01-0001", "667-01-0001"],
    "date": ["2024-02-29", "31.12.1999", "01/02/2003"],
    "ip": ["192.168.0.1", "0.0.0.0", "255.255.255.255"],
    "phone": ["+1 (988) 555-2485", "(212) 555-0199", "212-555-0199", "+49 30 1234567", "+33 1 23 45 67 89"],
}


@pytest.mark.parametrize("kind", list(VALID))
def test_valid_values_keep_their_format(spark, kind):
    values = VALID[kind]
    got = masked(spark, [f"before {v}, after." for v in values])
    again = masked(spark, [f"x {v}" for v in values])
    other = masked(spark, values, "another key")
    for value, text, second, third in zip(values, got, again, other, strict=True):
        new = text.removeprefix("before ").removesuffix(", after.")
        assert new != value and second == f"x {new}" and third != new
        if kind != "ip":
            assert shape(new) == shape(value)
        check = {
            "card": luhn,
            "iban": iban_ok,
            "ssn": lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000",
            "date": lambda v: datetime.date(*map(int, v.split("-") if "-" in v else re.split("[./]", v)[::-1])),
            "ip": lambda v: all(0 <= int(o) <= 255 for o in v.split(".")),
            "phone": lambda v: True,
        }[kind]
        assert check(new)
    assert got[0].endswith(", after.")


def test_equal_values_stay_linked_across_notations(spark):
    card = masked(spark, ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"])
    assert len({re.sub(r"\D", "", c) for c in card}) == 1
    phones = masked(spark, ["+1 (212) 555-0199", "(212) 555-0199", "+1 212 555 0199"])
    assert len({re.sub(r"\D", "", p)[-10:] for p in phones}) == 1
    mails = masked(spark, ["Ann@Example.org", "ann@example.org", "bob@example.org"])
    assert mails[0] == mails[1] != mails[2]
    dates = masked(spark, ["2001-02-03", "03.02.2001", "03/02/2001"])
    assert datetime.date.fromisoformat(dates[0]) == datetime.datetime.strptime(dates[1], "%d.%m.%Y").date()
    assert dates[1].replace(".", "/") == dates[2]


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112", "2023-02-29", "32.01.2000", "300.1.1.1", "1.2.3.4.5", "000-45-6789", "666-45-6789", "123-45-67890",
             "DE89370400440532013001", "0000000000000000", "plain 4.0. text 2,000 - 17", "a@b", "x4111111111111111", "", None,
             "12345678901234567890123"]
    assert masked(spark, texts) == texts


def test_mixed_text(spark):
    text = "Mail bosbt.42@mail8.example.com; 12 4610568901970798 and 555-4510 4610568901970798.\npassword=e3b3ed3cc8548923d6 token = \"0641917ea4e9feb9\""
    (new,) = masked(spark, [text])
    assert "bosbt" not in new and "4610568901970798" not in new and "e3b3ed" not in new and "0641917" not in new
    numbers = re.findall(r"\b\d{16}\b", new)
    assert len(numbers) == 2 and numbers[0] == numbers[1] and luhn(numbers[0])
    assert re.sub(r"user-\w+@example.com", "M", new).startswith("Mail M; 12 ")
    assert re.search(r'password=[0-9a-f]{18} token = "[0-9a-f]{16}"$', new)


def test_whole_table_and_counts(corpus, texts):
    mail = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")
    got = pseudonyms.pseudonymise(corpus, KEY).collect()
    assert len(got) == len(texts)
    for r in got:
        old, new = texts[r["doc_id"]], r["text"]
        assert r["n_replaced"] > 0 or old == new
        assert not set(mail.findall(old)) & set(mail.findall(new))
        assert not {n for n in re.findall(r"(?<!\w)\d{16}(?!\w)", old) if luhn(n)} & set(re.findall(r"\d{16}", new))


def test_odd_rows(spark, odd, nothing):
    out = pseudonyms.masked(odd, KEY)
    assert out.columns == odd.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert pseudonyms.masked(nothing, KEY).collect() == [] == pseudonyms.pseudonymise(nothing, KEY).collect()
    long = documents(spark, (1, "a" * 200_000 + "@" + "b." * 100_000), (2, "1 " * 100_000), (3, "+1 " * 50_000))
    assert pseudonyms.masked(long, KEY).count() == 3
    assert masked(spark, ["1" * 100_000])[0] == "1" * 100_000


def test_main_path_is_native(corpus):
    plan = pseudonyms.pseudonymise(corpus, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


NAME = re.compile(r"(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api[_-]?key)[\"']?\s*[=:]\s*")


def plain_secrets(text: str) -> list[tuple[int, str]]:
    """Secrets of a text and where they begin, character by character."""
    out, at = [], 0
    while (sign := NAME.search(text, at)) is not None:
        start = at = sign.end()
        quote = text[start : start + 1]
        line = re.split(r"[\r\n]", text[start + 1 :], maxsplit=1)[0] if quote in ("'", '"') else ""
        if line or quote in ("'", '"'):
            end, closed = 0, False
            while end < len(line):
                if line[end] == quote:
                    closed = True
                    break
                end += 2 if line[end] == "\\" else 1
            if closed:
                if end >= 8:
                    out.append((start + 1, line[:end]))
                    at = start + 1 + end
                continue
            if "'" in line or '"' in line:
                continue
            start += 1
        bare = re.match(r"\S*", text[start:])[0].rstrip(".,;:!?)]}\"'>")
        if len(bare) >= 8 and bare[0] not in "'\"":
            out.append((start, bare))
            at = start + len(bare)
    return out


SECRETS = [
    'password="p@ssword1234" end',
    'token = "abcd1234$efgh", "x"',
    '{"api_key": "ab\\"cd\\\\efgh ij", "user": "someone"}',
    '{"token":"short","user":"somebody-else"}',
    "secret: pa$$w0rd!!word, then more.",
    "(token=abcdefgh12)",
    "url?token=abc&x=12345678 rest",
    'password="no closing quote here1',
    "password='it''s open12345",
    'passwd="tab\there 123456"',
    "token: short password = \u00fcml\u00e4ut-\u65e5\u672c\u8a9e",
    'secret="' + "\\\\" * 30_000 + 'x" y',
    'secret="' + '\\"' * 30_000 + 'x" y',
    'token="' * 3000,
    "token=" * 20_000,
]


def test_secrets_of_any_characters(spark):
    for text, new in zip(SECRETS, masked(spark, SECRETS), strict=True):
        want, at = "", 0
        for place, secret in plain_secrets(text):
            want += text[at:place] + "#" * len(secret)
            at = place + len(secret)
        want += text[at:]
        assert len(new) == len(want), text[:60]
        assert all(b in "0123456789abcdef" if b2 == "#" else b == b2 for b, b2 in zip(new, want, strict=True)), (text[:60], new[:80])
    assert "p@ss" not in masked(spark, SECRETS[:1])[0] and "$efgh" not in masked(spark, SECRETS[1:2])[0]


def test_no_secret_of_the_corpus_stays(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    new = {r["doc_id"]: r["text"] for r in pseudonyms.masked(corpus, KEY).collect()}
    found = [(r["doc_id"], x) for r in corpus.collect() for _, x in plain_secrets(r["text"] or "")]
    assert len(found) >= 3
    assert [x for i, x in found if x in new[i]] == []


def test_key_of_the_session(spark):
    with pytest.raises(ValueError, match="pseudonymKey"):
        pseudonyms.session_key(spark)
    with pytest.warns(UserWarning, match="everyone knows"):
        assert pseudonyms.session_key(spark, "x") == "x"
    spark.conf.set(pseudonyms.KEY_SETTING, "own")
    try:
        assert pseudonyms.session_key(spark, "x") == pseudonyms.session_key(spark) == "own"
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)

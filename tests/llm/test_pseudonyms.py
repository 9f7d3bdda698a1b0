import datetime as dt
import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from tidemill.llm.pseudonyms import ROUNDS, op2, pseudonymise, stage


def permuted(symbols, radices, kind, key):
    """The network in plain Python."""
    s = list(symbols)
    h = len(s) // 2
    for k in range(ROUNDS):
        other = s[h:] if k % 2 == 0 else s[:h]
        d = hashlib.sha512(f"{key}|{kind}|{len(s)}|{k}|{','.join(map(str, other))}".encode()).hexdigest()
        for i in range(len(s)):
            if (i < h) == (k % 2 == 0):
                j = (i if i < h else i - h) % 32
                s[i] = (s[i] + int(d[4 * j : 4 * j + 4], 16)) % radices[i]
    return s


def luhn(payload):
    total = 0
    for i, c in enumerate(reversed(payload)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def run(spark, *texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonymise(docs, key).orderBy("doc_id").collect()]


def test_cards_against_plain_python(spark):
    payloads = [f"4{i:014d}" for i in range(40)]
    cards = [p + luhn(p) for p in payloads]
    got = run(spark, *cards)
    want = ["".join(map(str, permuted(map(int, p), [10] * 15, "card", "k"))) for p in payloads]
    assert got == [w + luhn(w) for w in want] and len(set(got)) == 40
    bad = [p + str((int(luhn(p)) + 1) % 10) for p in payloads]
    assert run(spark, *bad) == bad


def test_layouts_keep_and_equal_values_stay_linked(spark):
    card = "4845168114407329"
    a, b, c, d, e = run(spark, card, "4845-1681-1440-7329", f"x {card}, {card} 1.2.3.4.", "+1 (017) 555-7713 190.1.2.3", "(017) 555-7713")
    assert b.replace("-", "") == a and b[4] == b[9] == b[14] == "-"
    assert c.startswith(f"x {a}, {a} ") and re.fullmatch(r"(\d{1,3}\.){4}", c.rsplit(" ", 1)[1]) and "1.2.3.4" not in c
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} (\d{1,3}\.){3}\d{1,3}", d) and d[3:17] == e and "190.1.2.3" not in d


def test_dates_are_a_permutation(spark):
    days = [dt.date(1999, 12, 1) + dt.timedelta(n) for n in range(90)]
    iso = run(spark, *(f"{x:%Y-%m-%d}" for x in days))
    assert len(set(iso)) == 90 and all(1800 <= dt.date.fromisoformat(x).year <= 2199 for x in iso)
    german = run(spark, *(f"{x:%d.%m.%Y}" for x in days))
    assert [f"{dt.date.fromisoformat(x):%d.%m.%Y}" for x in iso] == german
    same = ["2023-02-29", "31.04.2020", "1799-01-01", "2020-13-01"]
    assert run(spark, *same) == same


def test_other_kinds(spark):
    texts = ["123-45-6789", "666-12-3456", "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "a.b34@mail7.example.com", "256.1.1.1", "12345", "token = \"ede43f42c939b6405768150e041159052\""]
    ssn, bad_ssn, iban, bad_iban, mail, bad_ip, short, token = run(spark, *texts)
    area, group, serial = map(int, ssn.split("-"))
    assert ssn != texts[0] and 0 < area < 900 and area != 666 and group and serial
    moved = iban.replace(" ", "")[4:] + iban[:4]
    assert iban != texts[2] and [len(x) for x in iban.split()] == [len(x) for x in texts[2].split()] and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    assert re.fullmatch(r"[a-z]\.[a-z]\d\d@mail7\.example\.com", mail) and mail != texts[4]
    assert [bad_ssn, bad_iban, bad_ip, short, token] == [texts[i] for i in (1, 3, 5, 6, 7)]
    assert run(spark, texts[0], key="other") != [ssn]


def test_messy_rows_and_plan(spark, messy, empty):
    out = pseudonymise(messy, "k")
    assert out.columns == messy.columns and sorted(r.text or "" for r in out.collect()) == sorted(r.text or "" for r in messy.collect())
    assert out.filter("text is null").count() == 2 and pseudonymise(empty, "k").collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query_replaces_all_and_only_what_it_finds(spark, small):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    after = {r.doc_id: r for r in op2(spark, small).collect()}
    assert after.keys() == before.keys()
    for i, text in before.items():
        for m in re.findall(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}", text):
            assert m not in after[i].text
        if not re.search(r"[0-9]{2}|@", text):
            assert after[i].text == text
        assert after[i].n_chars == len(after[i].text)
    assert stage(spark, spark.read.parquet(f"{small}/documents.parquet"), small).filter(F.col("text").isNull()).count() == 0


def test_dates_with_the_month_first_are_a_permutation_of_such_dates(spark):
    days = [dt.date(2023, 12, 1) + dt.timedelta(n) for n in range(500)]
    days = [d for d in days if d.day > 12] + [dt.date(y, 2, 29) for y in range(1900, 2150) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
    texts = sorted({f"{d:%m/%d/%Y}" for d in days})
    out = run(spark, *texts)
    assert len(set(out)) == len(texts) and sum(a == b for a, b in zip(out, texts, strict=True)) < 3
    for a, b in zip(texts, out, strict=True):
        d = dt.datetime.strptime(b, "%m/%d/%Y")
        assert d.day > 12 and 1800 <= d.year <= 2199 and (a[:5] == "02/29") == (b[:5] == "02/29")
    y, m, d = permuted([2024 - 1800, 11, 25 - 13], [400, 12, 16], "month-first", "k")
    assert run(spark, "on 12/25/2024.", "13/25/2024", "02/30/2024", "02/29/2023") == [f"on {m + 1:02}/{d + 13}/{y + 1800}.", "13/25/2024", "02/30/2024", "02/29/2023"]


def test_leap_days_are_permuted_by_rounds(spark):
    """All 97 leap days with the month first are permuted among themselves, by no common shift, and another key moves them otherwise."""
    leaps = [f"02/29/{y}" for y in range(1800, 2200) if _exists(y, 2, 29)]
    maps = []
    for key in ("k", "l"):
        new = dict(zip(leaps, (r.text for r in sorted(pseudonymise(spark.createDataFrame([(i, t) for i, t in enumerate(leaps)], "i int, text string"), key).collect(), key=lambda r: r.i)), strict=True))
        assert sorted(new.values()) == leaps and len({int(v[6:]) - int(k[6:]) for k, v in new.items()}) > 60
        maps.append(new)
    assert sum(maps[0][k] == maps[1][k] for k in leaps) < 10


def _exists(y, m, d):
    try:
        return bool(dt.date(y, m, d))
    except ValueError:
        return False

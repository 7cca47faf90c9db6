import datetime
import re

from lexloom.llm import pseudonyms

from .fixtures import SCHEMA, awkward


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(d)) % 10 == 0


def with_check(head):
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pseudonyms.pseudonymise(df).collect()}


def test_formats_stay_valid_and_equal_values_linked(spark):
    cards = [with_check(f"4{i:014d}") for i in range(40)]
    phones = [f"+1 ({200 + i}) 555-{i:04d}" for i in range(40)]
    days = [datetime.date(1999, 12, 1) + datetime.timedelta(i) for i in range(60)]
    texts = [f"a {x} b, {x}." for x in cards + phones] + [f"on {d} or {d:%d.%m.%Y}" for d in days] + ["x 45.240.18.69 y 123-45-6789 z", "mail ann.b+c@mail.example.com now", "mail Ann.b+c@mail.example.com"]
    got = run(spark, texts)
    new = []
    for i, x in enumerate(cards + phones):
        m = re.fullmatch(r"a (.*) b, (.*)\.", got[i]["text"])
        assert m and m[1] == m[2] and len(m[1]) == len(x) and got[i]["n_found"] in (0, 2)
        assert re.sub(r"\d", "9", m[1]) == re.sub(r"\d", "9", x)
        assert luhn(m[1]) if i < len(cards) else m[1].startswith("+1 (") and m[1][4] >= "1" and m[1][9] >= "1"
        new.append(m[1])
    assert len(set(new)) == len(new) and sum(a != b for a, b in zip(new, cards + phones, strict=True)) >= len(new) - 2
    dates = []
    for i, d in enumerate(days, len(cards + phones)):
        m = re.fullmatch(r"on (\d{4}-\d\d-\d\d) or (\d\d)\.(\d\d)\.(\d{4})", got[i]["text"])
        assert m[1] == f"{m[4]}-{m[3]}-{m[2]}" and datetime.date.fromisoformat(m[1]).year // 100 == d.year // 100
        dates.append(m[1])
    assert len(set(dates)) == len(days)
    ip, mail, again = (got[len(texts) - k]["text"] for k in (3, 2, 1))
    m = re.fullmatch(r"x (\d+\.\d+\.\d+\.\d+) y (\d{3}-\d\d-\d{4}) z", ip)
    assert m and m[1] != "45.240.18.69" and all(int(x) < 256 for x in m[1].split(".")) and m[2] != "123-45-6789"
    assert "ann" not in mail.lower() and mail == f"{again} now"


def test_the_networks_are_bijections(spark):
    for a, b in ((92, 397), (75, 487), (10, 100), (7, 3)):
        n = a * b
        sql = pseudonyms.feistel("id", a, b, "'k'")
        assert sorted(r[0] for r in spark.range(n).selectExpr(f"{sql} as x").collect()) == list(range(n))


def test_what_is_not_valid_stays(spark):
    texts = ["4980828778982125", "300.1.1.1", "0.1.2.3", "2023-02-30", "1899-01-01", "31.31.2001", "666-12-1234", "123-00-1234", "(023) 555-1234", "a@b", "12345", "1.2.3", "no digits @ all", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", ""]
    got = run(spark, [*texts, None])
    assert [got[i]["text"] for i in range(len(texts))] == texts and got[len(texts)]["text"] is None and not any(r["n_found"] for r in got.values())


def test_awkward_rows_and_planted_data(spark):
    rows = awkward()
    found = pseudonyms.pseudonymise(spark.createDataFrame(rows, SCHEMA))
    assert found.count() == len(rows) and pseudonyms.pseudonymise(found.limit(0)).count() == 0
    assert {(r["doc_id"], r["text"]) for r in found.collect()} == {(r[0], r[1]) for r in rows}
    sf = "/root/testdata/sf0.01"
    old = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    personal = re.compile(r"[\w.]+@mail\d\.example\.com|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d+\.\d+\.\d+\.\d+")
    n = 0
    for r in pseudonyms.op7_pseudonyms(spark, sf).collect():
        values = [v for v in set(personal.findall(old[r["doc_id"]])) if not re.fullmatch(r"\d{16}", v) or luhn(v)]
        n += len(values)
        assert not [v for v in values if v in r["text"]]
        assert r["n_found"] or r["text"] == old[r["doc_id"]]
    assert n > 10


def test_phones_with_any_area_and_exchange(spark):
    numbers = [f"+1 ({a:03d}) {x:03d}-{i:04d}" for i, (a, x) in enumerate((a, x) for a in (0, 17, 99, 100, 984) for x in (0, 17, 99, 100, 555))]
    got = run(spark, [f"{n} and {n[3:]}" for n in numbers])
    new = []
    for i, n in enumerate(numbers):
        a, b = got[i]["text"].split(" and ")
        assert a != n and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and (a[4] == "0") == (n[4] == "0") and (n[4] == "0" or (a[9] == "0") == (n[9] == "0"))
        assert b == (n[3:] if n[4] == "0" else a[3:])
        new.append(a)
    assert len(set(new)) == len(new)


def test_planted_phones_of_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(r"text rlike '[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}'").select("doc_id", "text")
    old, n = {r["doc_id"]: r["text"] for r in docs.collect()}, 0
    for r in pseudonyms.pseudonymise(docs).collect():
        phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", old[r["doc_id"]])
        n += len(phones)
        assert not [x for x in phones if x in r["text"]]
    assert n > 100


def test_neighbours_do_not_hide_values(spark):
    one, two, odd = "4111111111111111", "4111 1111 1111 1111", with_check("37828224631000")
    cases = [(f"{one} 25 items", [one]), (f"12 {one}", [one]), (f"{one} {one}", [one]), (f"no 7 {two} 25", [two]), (f"{two} 2021 and", [two]), (f"{odd[:4]} {odd[4:10]} {odd[10:]} 12", [odd[4:10]])]
    cases += [("41111 11111 111111 25", ["41111 11111 111111"]), ("555-123-4567 2021", ["555-123-4567"]), ("1 555-123-4567 20215", ["555-123-4567"]), (f"{one} 555.123.4567", [one, "555.123.4567"])]
    cases += [(f"{one} 8.8.4.4", [one, "8.8.4.4"]), (f"{one} 2020-01-05", [one, "2020-01-05"]), (f"{one} 123-45-6789", [one, "123-45-6789"]), (f"{one} 12ab@x.com", [one, "12ab@x.com"]), ("see 8.8.8.8", ["8.8.8.8"])]
    cases += [(f"{one} 1 (555) 123-4567", [one, "(555) 123-4567"]), (f"{two}-{one}", [two, one])]
    got = run(spark, [x for x, _ in cases] + [f"{one}"])
    for i, (x, values) in enumerate(cases):
        assert not [v for v in values if v in got[i]["text"]], (x, got[i]["text"])
        assert got[i]["n_found"] == len(got[i]["pseudonyms"]) >= len(values) and all(p in got[i]["text"] for p in got[i]["pseudonyms"])
    new = got[len(cases)]["text"]
    assert got[0]["text"] == f"{new} 25 items" and got[1]["text"] == f"12 {new}" and got[2]["text"] == f"{new} {new}" and got[2]["n_found"] == 2


def test_all_planted_data_of_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    old = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    personal = re.compile(r"[\w.]+@mail\d\.example\.com|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d+\.\d+\.\d+\.\d+")
    for r in pseudonyms.op7_pseudonyms(spark, sf).collect():
        values = [v for v in set(personal.findall(old[r["doc_id"]] or "")) if not re.fullmatch(r"\d{16}", v) or luhn(v)]
        assert not [v for v in values if v in r["text"]], r["doc_id"]

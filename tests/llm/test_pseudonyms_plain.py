"""The pseudonyms against a plain version of each format's permutation."""

import datetime
import hashlib
import random

from lexloom.llm import pseudonyms

from .test_pseudonyms import luhn, with_check

KEY = "secret"


def plain_feistel(number, a, b, *tweak):
    x, y = divmod(number, b)
    for i in range(8):
        mixed = lambda other, i=i: int(hashlib.md5("|".join(map(str, (KEY, *tweak, i, other))).encode()).hexdigest()[:14], 16)
        if i % 2 == 0:
            x = (x + mixed(y) % a) % a
        else:
            y = (y + mixed(x) % b) % b
    return x * b + y


def refilled(old, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in old)


def card(text):
    digits = "".join(c for c in text if c.isdigit())
    head = digits[:-1]
    n = len(head)
    return refilled(text, with_check(str(plain_feistel(int(head), 10 ** (n // 2), 10 ** (n - n // 2), "card", n)).zfill(n)))


def phone(text):
    digits = "".join(c for c in text if c.isdigit())
    before, d = digits[:-10], digits[-10:]
    area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
    low_area, low, size, a, b, kind = (0, 0, 1000, 40000, 25000, "phone0") if area < 100 else (100, 0, 100, 30000, 30000, "phone1") if exchange < 100 else (100, 100, 900, 90000, 90000, "phone")
    q = plain_feistel(((area - low_area) * size + exchange - low) * 10000 + line, a, b, kind)
    return refilled(text, before + f"{q // (size * 10000) + low_area:03d}{q // 10000 % size + low:03d}{q % 10000:04d}")


def ip(text):
    o = [int(x) for x in text.split(".")]
    q = plain_feistel(o[0] * 2**24 + o[1] * 2**16 + o[2] * 256 + o[3] - 2**24, 255 * 256, 65536, "ip") + 2**24
    return ".".join(str(q >> s & 255) for s in (24, 16, 8, 0))


def ssn(text):
    a, g, r = map(int, text.split("-"))
    q = plain_feistel(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + r - 1, 898 * 99, 9999, "ssn")
    v = q // 989901 + 1
    return f"{v + (v >= 666):03d}-{q // 9999 % 99 + 1:02d}-{q % 9999 + 1:04d}"


def date(day):
    first, a, b, kind = (datetime.date(1900, 1, 1), 92, 397, "date19") if day.year < 2000 else (datetime.date(2000, 1, 1), 75, 487, "date20")
    return first + datetime.timedelta(plain_feistel((day - first).days, a, b, kind))


def email(text):
    h = hashlib.md5(f"{KEY}|email|{text.lower()}".encode()).hexdigest()
    return f"u{h[:12]}@m{h[12:20]}.example"


def test_values_equal_a_plain_permutation(spark):
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cases = []
    for _ in range(40):
        number = with_check(digits(15))
        cases += [(x, card(x)) for x in (number, " ".join(number[i : i + 4] for i in range(0, 16, 4)), with_check("37" + digits(12)))]
        cases += [(x, phone(x)) for x in (f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"1-{digits(3)}-{digits(3)}-{digits(4)}", f"({rng.randrange(100, 1000)}) {digits(3)}-{digits(4)}")]
        address = ".".join(str(rng.randrange(k == 0, 256)) for k in range(4))
        person = f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 600)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        cases += [(address, ip(address)), (person, ssn(person))]
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))
        cases += [(f"{day:{f}}", f"{date(day):{f}}") for f in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y")]
        mail = f"User.{digits(3)}@{rng.choice(['a.example', 'B.example.org'])}"
        cases.append((mail, email(mail)))
    assert all(luhn(x) for x, _ in cases[:3])
    docs = spark.createDataFrame([(i, f"see {x}, {x} here") for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(docs, KEY).collect()}
    wrong = [(x, y, got[i]) for i, (x, y) in enumerate(cases) if got[i] != f"see {y}, {y} here"]
    assert not wrong, wrong[:5]

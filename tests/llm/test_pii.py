import datetime
import hashlib
import random
import re

import pytest

from bazaar.llm import pii as m

KEY = "k"


def h(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:15], 16)


def permute(v, a, b, kind):
    left, right = divmod(v, b)
    for i in range(1, m.ROUNDS + 1):
        if i % 2:
            left = (left + h(kind, i, right)) % a
        else:
            right = (right + h(kind, i, left)) % b
    return left * b + right


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def put(mask, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), mask)


def brute_force(s):
    """The pseudonym of one value, None if it fails validation."""
    d = re.sub(r"\D", "", s)
    if re.fullmatch(r"(19|20)\d\d(.)\d\d\2\d\d|\d\d(.)\d\d\3(19|20)\d\d", s):
        iso = s[:4].isdigit()
        y, mo, da = (s[:4], s[5:7], s[8:]) if iso else (s[6:], s[3:5], s[:2])
        try:
            v = (datetime.date(int(y), int(mo), int(da)) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return None
        v = permute(v, 270, 271, "date")
        while v >= m._DAYS:
            v = permute(v, 270, 271, "date")
        new = datetime.date(1900, 1, 1) + datetime.timedelta(v)
        sep = s[4] if iso else s[2]
        return new.strftime(f"%Y{sep}%m{sep}%d" if iso else f"%d{sep}%m{sep}%Y")
    if re.fullmatch(r"\d+(\.\d+){3}", s):
        v = permute(int.from_bytes(bytes(map(int, s.split("."))), "big"), 1 << 16, 1 << 16, "ip")
        return ".".join(map(str, v.to_bytes(4, "big")))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", s):
        a, g, n = map(int, s.split("-"))
        v = permute((((a - 2) if a > 666 else a - 1) * 99 + g - 1) * 9999 + n - 1, 898, 99 * 9999, "ssn")
        a, v = divmod(v, 99 * 9999)
        return f"{a + 2 if a > 664 else a + 1:03}-{v // 9999 + 1:02}-{v % 9999 + 1:04}"
    if 13 <= len(d) <= 19 and not s.startswith("+"):
        if not luhn(d):
            return None
        n = len(d) - 2
        body = d[0] + str(permute(int(d[1:-1]), 10 ** (n // 2), 10 ** (n - n // 2), "card")).zfill(n)
        return put(s, body + next(c for c in "0123456789" if luhn(body + c)))
    if s.startswith("+") and not d.startswith("1"):
        head = 2 if d[0] == "7" else 3 if d[:2] in "20 27 44 49 33 61".split() else 4
        n = len(d) - head
        v = permute(int(d[head:]), 10 ** (n // 2), 10 ** (n - n // 2), "phone+" + d[:head])
        return put(s, d[:head] + str(v).zfill(n)) if 8 <= len(d) <= 15 else None
    own = d[-10:]
    v = permute(((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10000 + int(own[6:]), 800, 8_000_000, "phone")
    return put(s, d[:-10] + f"{v // 8_000_000 + 200}{v // 10000 % 800 + 200}{v % 10000:04}")


def values(seed):
    rng = random.Random(seed)
    out = ["2021-02-30", "4041894974608796", "29.02.1900", "1900-01-01", "2099-12-31", "665-01-0001", "667-99-9999", "899-99-9999", "001-01-0001"]
    out += ["+44 20 7946 0958", "+966512345678", "+7 (999) 123-45-67", "+49-30-123456", "+9989012", "+33.12.34.56.78"]
    for _ in range(25):
        out.append(f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04}")
        out.append(f"{rng.randint(200, 999)}.{rng.randint(200, 999)}.{rng.randint(0, 9999):04}")
        body = "".join(rng.choices("0123456789", k=rng.randint(12, 18)))
        out.append(body + next(c for c in "0123456789" if luhn(body + c)))
        out.append(".".join(str(rng.randint(0, 255)) for _ in range(4)))
        out.append(f"{rng.randint(1, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}")
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(m._DAYS))
        out.append(day.strftime(rng.choice(["%Y-%m-%d", "%d/%m/%Y", "%Y.%m.%d"])))
    return out


def test_as_brute_force(make):
    vals = values(1)
    rows = [(i, f"Some words, {v}; and {vals[-1 - i]}.") for i, v in enumerate(vals)]
    got = {r["doc_id"]: r["text"] for r in m.pseudonymise(make(rows), KEY).collect()}
    for i, v in enumerate(vals):
        assert got[i] == f"Some words, {brute_force(v) or v}; and {brute_force(vals[-1 - i]) or vals[-1 - i]}."


def test_permutation():
    assert sorted(permute(v, 27, 40, "x") for v in range(27 * 40)) == list(range(27 * 40))


def test_letters(make):
    mails = [f"{x}.{i}@mail.example.com" for i in range(40) for x in ("anna", "Bob_k")]
    secrets = [f'token = "{hashlib.sha1(bytes([i])).hexdigest()}"' for i in range(20)]
    text = [(i, t) for i, t in enumerate(mails + secrets + mails)]
    got = [r["text"] for r in m.pseudonymise(make(text), KEY).orderBy("doc_id").collect()]
    assert got[:80] == got[-80:] and len(set(got)) == 100
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))
    for old, new in zip(mails, got, strict=False):
        assert old != new and shape(old.split("@")[0]) == shape(new.split("@")[0]) and new.endswith("@mail.example.com")
    for new in got[80:100]:
        assert re.fullmatch(r'token = "[0-9a-f]{40}"', new)


@pytest.mark.parametrize("value", ["aB3_" * 32 + "z", "q" * 5000, "0123456789abcdef" * 3000, "1234567890123", "4041894974608797", "1234-5678-9012-3456", "2021-02-30"])
@pytest.mark.parametrize("name", ["password=", "Password=", "API_KEY: '", "a@b.token="])
def test_secrets_of_any_length_and_form(make, name, value):
    row = m.pseudonymise(make([(1, f"My {name}{value}, and {value[:40]}.")]), KEY).first()
    old, new = value, row["text"][len(f"My {name}") if "@" not in name else row["text"].index("token=") + 6 :][: len(value)]
    assert new != old and len(row["text"]) == len(f"My {name}{value}, and {value[:40]}.") and row["text"].endswith(f", and {value[:40]}.")
    assert [sum(c.isdigit() for c in x) for x in (old, new)][0] == sum(c.isdigit() for c in new) or re.fullmatch("[0-9a-f]+", new)
    assert [r["kind"] for r in row["pii"]][-1] == "secret"


def test_clean_text_stays(make, odd):
    clean = ["In 1999, 12 of 340 (3.5 %) came.", "v1.2.3.4.5 and 300.1.2.3", "000-12-3456 or 666-12-3456", "1234567890123", "a1b2-2020-01-01x", ""]
    got = m.pseudonymise(make(list(enumerate(clean))), KEY).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == clean and all(r["pii"] == [] for r in got)
    texts = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    assert texts(m.pseudonymise(odd, KEY)) == texts(odd)
    assert {r["pii"] is None for r in m.pseudonymise(odd, KEY).collect() if r["doc_id"] == 1} == {True}
    assert m.pseudonymise(make([]), KEY).collect() == []


@pytest.mark.parametrize("junk", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a.b-c@" * 50_000])
def test_long_runs_take_linear_time(make, junk):
    assert m.pseudonymise(make([(1, junk)]), KEY).first()["text"] is not None


def test_native(make):
    plan = m.pseudonymise(make([(1, "x")]), KEY)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text", ["password=P@ssw0rd!123", "password=hunter2!", "token=abc$def#ghi12345 and more", 'passwd = "S3cr3t!!value"', "password: correct-horse.battery", "password=me@corp.com", "secret = 'two words 77'", "Token: \"a.b.c.d.e.f\" rest"])
def test_secrets_with_punctuation(make, text):
    (row,) = m.pseudonymise(make([(1, text)]), KEY).collect()
    value = text.split("=" if "=" in text else ":", 1)[1].strip()
    value = value[1 : value.index(value[0], 1)] if value[0] in "\"'" else value.split()[0]
    assert [p["kind"] for p in row["pii"]] == ["secret"] and len(row["text"]) == len(text)
    start = text.index(value)
    assert row["text"][:start] == text[:start] and row["text"][start + len(value) :] == text[start + len(value) :]
    new = row["text"][start : start + len(value)]
    assert sum(a == b for a, b in zip(new, value, strict=True) if a.isalnum()) <= 3


def test_addresses_cards_and_phones_of_other_forms(make):
    mails = ["jörg.müller@example.de", "Åsa.Öberg@example.se"]
    out = [r["text"] for r in m.pseudonymise(make([(i, f"to {m}!") for i, m in enumerate(mails)]), KEY).collect()]
    for old, new in zip(mails, sorted(out, key=lambda t: "se!" in t), strict=True):
        local = new[3 : new.index("@")]
        assert len(local) == old.index("@") and sum(a == b for a, b in zip(local, old, strict=False) if a.isalpha()) <= 3
    rows = m.pseudonymise(make([(1, "3782 822463 10005"), (2, "(212)5550199"), (3, "(212) 555-0199")]), KEY).collect()
    assert {r["doc_id"]: [p["kind"] for p in r["pii"]] for r in rows} == {1: ["card"], 2: ["phone"], 3: ["phone"]}

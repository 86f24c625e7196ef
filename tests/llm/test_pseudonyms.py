import datetime as dt
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import edge
from vouch.llm import pseudonyms as P

PERMUTER = P.Permuter(b"key")
TEXT = ("Mail ann.b42@mail.example.com, call +1 (988) 555-2485 or 988-555-2485; host 42.144.35.254. Card 4041894974608795 or "
        "4041 8949 7460 8795, born 1999-12-31 or 31.12.1999 or 12/31/1999, ssn 123-45-6789, DE89 3704 0044 0532 0130 00, "
        "password=b7db7aa4a5fcc78305 token = \"bc0d31ba76f17e56642e8751295a3fd50cd8e61f\".")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutes_every_domain(size):
    out = [PERMUTER.number(x, size, "t") for x in range(size)]
    assert sorted(out) == list(range(size))
    assert [PERMUTER.number(y, size, "t", True) for y in out] == list(range(size))


def test_values_are_valid_linked_and_turned_back():
    new, spans = P.pseudonymise(TEXT, PERMUTER)
    assert [k for k, *_ in spans] == ["email", "phone", "phone", "ip", "card", "card", "iso", "dmy", "mdy", "ssn", "iban", "hex", "hex"]
    assert P.pseudonymise(new, PERMUTER, back=True)[0] == TEXT
    value = [new[s:s + n] for _, s, n in spans]
    assert re.sub(r"\D", "", value[1])[-10:] == re.sub(r"\D", "", value[2])
    assert value[4] == value[5].replace(" ", "") and P.luhn_digit(value[4][:-1]) == value[4][-1]
    days = [dt.date.fromisoformat(value[6]), dt.datetime.strptime(value[7], "%d.%m.%Y").date(), dt.datetime.strptime(value[8], "%m/%d/%Y").date()]
    assert len(set(days)) == 1
    assert not any(old in new for old in ("ann.b42", "555-2485", "42.144", "4041894", "123-45-6789", "b7db7aa4"))
    assert P.pseudonymise(TEXT, P.Permuter(b"other"))[0] != new


@pytest.mark.parametrize("text", ["4041894974608796", "0445617099674829", "1.2.3", "Version 2.0.", "300.1.2.3", "2021-02-30", "99.99.2001",
                                  "000-12-3456", "DE00370400440532013000", "x", "", "1111111111111111"])
def test_values_that_break_their_rules_stay(text):
    assert P.pseudonymise(text, PERMUTER) == (text, [])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_taken(text):
    new, spans = P.pseudonymise(f"{text} 42.144.35.254 {text}", PERMUTER)
    assert all(new[s:s + n] for _, s, n in spans)


def test_different_values_stay_different():
    rng = random.Random(1)
    cards = {(b := "4" + "".join(rng.choice("0123456789") for _ in range(14))) + P.luhn_digit(b) for _ in range(2000)}
    assert len({P.replace_value("card", c, PERMUTER) for c in cards}) == len(cards)


def test_edge_rows_and_empty_tables(spark):
    out = P.pseudonymise_documents(edge.documents(spark), b"key")
    assert edge.rows(out, "doc_id", "text") == sorted(((r[0], r[1]) for r in edge.ROWS), key=repr)
    assert P.pseudonymise_documents(edge.empty(spark), b"key").count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000 + "42.144.35.254")], "doc_id bigint, text string")
    assert P.pseudonymise_documents(long, b"key").first()["n_found"] == 1


def test_time_grows_with_the_length_alone():
    import time

    p = P.Permuter(b"key")
    for unit in ("%20b", "%a@b.c-", "1@1.", "a.", "AB12 ", "password= ", "+49 (0) ", "(123) "):
        start = time.perf_counter()
        P.pseudonymise(unit * ((1 << 20) // len(unit)), p)
        assert time.perf_counter() - start < 8, unit  # quadratic search took a quarter of an hour
    start = time.perf_counter()
    text = "%20b" * (1 << 18) + " mail bob@example.com"
    out, found = P.pseudonymise(text, p)
    assert time.perf_counter() - start < 4 and [k for k, *_ in found] == ["email"] and out != text
    assert P.pseudonymise("a" * 70 + "@example.com", p)[1] == []  # longer than an address can be


def test_pseudonyms_equal_a_plain_feistel_network():
    from hashlib import blake2b

    secret = blake2b(b"key", digest_size=32).digest()

    def plain(x, size, kind):
        """Eight rounds on halves of the bits, walked until inside, from the description alone."""
        bits = max(2, len(bin(size - 1)) - 2)
        half = (bits + bits % 2) // 2
        while True:
            left, right = divmod(x, 1 << half)
            for turn in range(8):
                size_of = (half + 7) // 8
                h = blake2b(f"{kind}|{turn}|{right:x}|0".encode(), key=secret, digest_size=size_of).digest()
                left, right = right, left ^ (int.from_bytes(h, "big") % (1 << half))
            x = left * (1 << half) + right
            if x < size:
                return x

    p = P.Permuter(b"key")
    for value in ("10.1.2.3", "192.168.0.255"):
        a, b, c, d = map(int, value.split("."))
        x = plain(((a - 1) * 256 + b) * 65536 + c * 256 + d, 223 * 2 ** 24, "ip")
        want = f"{x // 2 ** 24 + 1}.{x // 65536 % 256}.{x // 256 % 256}.{x % 256}"
        assert P.pseudonymise(f"at {value} now", p)[0] == f"at {want} now"
    body = "4" + str(plain(11111111111111, 10 ** 14, "card164")).zfill(14)
    assert P.pseudonymise("4111111111111111", p)[0] == body + P.luhn_digit(body)
    day = plain((__import__("datetime").date(2020, 1, 2) - __import__("datetime").date(1900, 1, 1)).days, 73049, "date")
    assert P.pseudonymise("2020-01-02", p)[0] == str(__import__("datetime").date(1900, 1, 1) + __import__("datetime").timedelta(day))

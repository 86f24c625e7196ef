"""Values that the forms of the first version left in clear."""

import random
import re

import pytest

from vouch.llm import pseudonyms as P

PERMUTER = P.Permuter(b"key")


def one(value, kind, before="Call ", after=" now."):
    """The pseudonym of the only value of a text, which can be turned back."""
    text = before + value + after
    new, spans = P.pseudonymise(text, PERMUTER)
    assert [k for k, *_ in spans] == [kind], (text, spans)
    _, start, n = spans[0]
    assert new[:start] == before and new[start + n:] == after and n == len(value) and new[start:start + n] != value
    assert P.pseudonymise(new, PERMUTER, back=True)[0] == text
    return new[start:start + n]


def test_phones_of_any_area_code_change_and_link():
    rng = random.Random(3)
    seen = set()
    for area in ["017", "100", "000", "199", *(f"{rng.randrange(1000):03d}" for _ in range(200))]:
        a, b = one(f"+1 ({area}) 555-7713", "phone"), one(f"{area}-555-7713", "phone")
        assert a.startswith("+1 (") and re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b)
        assert one(f"+1{area}5557713", "phone") == "+" + re.sub(r"\D", "", a)
        seen.add((area, b))
    assert len({b for _, b in seen}) == len(seen)


@pytest.mark.parametrize("value", ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958", "+49 30 901820", "+49-151-12345678", "+33 1 23 45 67 89",
                                   "+7 495 123-45-67", "+353 1 234 5678", "+39 (06) 1234567", "+683 4000"])
def test_phones_of_other_countries_change(value):
    new = one(value, "phone")
    code = 1 if value[1] == "7" else 3 if value.startswith(("+353", "+683")) else 2
    assert new[:code + 1] == value[:code + 1]
    assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", value)


def test_layouts_of_a_foreign_phone_link():
    assert {re.sub(r"\D", "", one(v, "phone").replace("(0)", "")) for v in ("+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958")}.__len__() == 1


@pytest.mark.parametrize("text", ["2 +3 4", "a+123456789", "+12 34", "+1234567890123456", "+0123456789"])
def test_other_numbers_after_a_plus_stay(text):
    assert P.pseudonymise(text, PERMUTER) == (text, [])


@pytest.mark.parametrize("before, after", [("Card ", " 12/25"), ("Card ", " 12"), ("Pay 7 ", " now"), ("No 12 ", " 99 x"), ("", " 123")])
def test_cards_beside_other_digits_change_and_turn_back(before, after):
    rng = random.Random(4)
    for _ in range(200):
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        d += P.luhn_digit(d)
        card = " ".join(d[i:i + 4] for i in range(0, 16, 4))
        text = before + card + after
        new, spans = P.pseudonymise(text, PERMUTER)
        assert [k for k, *_ in spans] == ["card"] and card not in new
        assert P.pseudonymise(new, PERMUTER, back=True)[0] == text


def test_the_reviewed_card_and_ibans_change():
    new = one("4111 1111 1111 1111", "card", "Card ", " 12/25")
    assert P.luhn_digit(new.replace(" ", "")[:-1]) == new[-1] and one("4111111111111111", "card") == new.replace(" ", "")
    for value, after in [("AT61 1904 3002 3457 3201", " IBAN"), ("BE71 0961 2345 6769", " A"), ("BE71 0961 2345 6769", " A 4111 b")]:
        assert one(value, "iban", "To ", after) == one(value, "iban")


@pytest.mark.parametrize("value", ["NO9386011117947", "DK50 0040 0440 1162 43", "FI21 1234 5600 0007 85", "MT84MALT011000012345MTLCAST001S",
                                   "SA03 8000 0000 6080 1016 7519", "LU28 0019 4006 4475 0000"])
def test_ibans_of_other_countries_change(value):
    new = one(value, "iban", "To ", ".").replace(" ", "")
    assert new[:2] == value[:2] and P._iban_check(new[:2], new[4:]) == new[2:4]


def test_a_value_inside_a_refused_match_changes():
    new, spans = P.pseudonymise("Codes AA11 4111 1111 1111 1111 and 1 4111 1111 1111 1111.", PERMUTER)
    assert [k for k, *_ in spans] == ["card", "card"] and "4111 1111" not in new

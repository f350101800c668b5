"""Identifiers after a cue."""

import pytest
from pareframe.llm import pii

IBAN = "DE89370400440532013000"


@pytest.mark.parametrize(
    "text, spans",
    [
        ("account: 12345678", ["12345678"]),
        ("Acct no. 0012345678, thanks", ["0012345678"]),
        ("account number is 12345678.", ["12345678"]),
        (f"IBAN number is {IBAN}", [IBAN]),
        ("my SSN number is 123-45-6789", ["123-45-6789"]),
        (f"account IBAN: {IBAN}", [IBAN]),
        ("iban: 12345678", []),
        ("account since 2020", []),
        ("accounting 12345678", []),
        ("account 2020-01-02", []),
        ("account 12345678901234567890", []),
    ],
)
def test_account(text, spans):
    assert [text[a:b] for k, a, b in pii.spans_of(text, pii.anchors()) if k == "account"] == spans

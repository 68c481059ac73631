"""How many random keys are found, and what is left alone."""

import random
import string

import pytest

from lectern.llm import secrets

ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "lower": string.ascii_lowercase + string.digits,
    "letters": string.ascii_letters,
    "alnum": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
}


@pytest.mark.parametrize("name", sorted(ALPHABETS))
@pytest.mark.parametrize("before", ["see ", "key=", "id/"])
def test_random_keys_of_twenty_characters(name, before):
    rng, scan = random.Random(name + before), secrets.scanner()
    found = sum(bool(scan(before + "".join(rng.choices(ALPHABETS[name], k=20)) + " end")) for _ in range(500))
    assert found >= 450


def test_names_of_words_are_left_alone():
    scan = secrets.scanner()
    names = (
        "InternationalizationHelper2Factory AbstractSingletonProxyFactoryBean getElementsByTagNameAndClass "
        "TransactionAwarePersistenceManagerFactoryProxy a-rather-long-hyphenated-name-of-words "
        "https://example.org/Documentation/GettingStarted/InstallationGuide 12345678901234567890123"
    )
    assert scan(names) == []

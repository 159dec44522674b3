import random

import pytest


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def make_words():
    return words


@pytest.fixture(scope="session")
def documents_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"

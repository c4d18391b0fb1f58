import random

import pytest


@pytest.fixture
def prose():
    """A maker of random texts over a small vocabulary."""
    rng = random.Random(5)
    words = ["the", "of", "and", "river", "stone", "Light", "walk", "under", "seven", "green", "house", "Ångström", "café", "naïve", "über", "x1", "3.5", "it's", "we'll", "end."]

    def make(n):
        return " ".join(rng.choice(words) for _ in range(n))

    make.rng = rng
    return make

import random

import pytest

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()


@pytest.fixture
def rng():
    return random.Random(7)


def sentence(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))

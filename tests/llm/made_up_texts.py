"""Texts for tests."""

import random

WORDS = "the of and to in is that for it with as was on be at by this are from or an have not one".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ed", "ing", "er", "tion", "ly"]) for _ in range(n))

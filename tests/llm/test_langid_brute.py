"""Language identification against plain counting, a grid over proportions and all sets of languages."""

import itertools
import math
import random

import numpy as np
import pytest

from veilframe.llm import langid

VOICES = {"aa": "abcdefgh", "bb": "fghijklm", "cc": "nopqrstu"}


def words(r, lang, n):
    return " ".join("".join(r.choice(VOICES[lang]) for _ in range(r.randrange(2, 7))) for _ in range(n))


def plain_grams(text):
    """Buckets of n-grams of letters, everything else one space, by whole-number arithmetic."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    if not kept.strip():
        return {}
    kept = " " + " ".join(kept.split()) + " "
    out = {}
    for i in range(len(kept) - langid.GRAM + 1):
        h = ord(kept[i])
        for c in kept[i + 1 : i + langid.GRAM]:
            h = (h * 0x9E3779B1 + ord(c)) % 2**32
        b = (h * 0x85EBCA77) % 2**32 >> (32 - langid.BITS)
        out[b] = out.get(b, 0) + 1
    return out


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    counts = np.zeros((1 << langid.BITS, len(VOICES)))
    for k, lang in enumerate(VOICES):
        for b, n in plain_grams(words(r, lang, 3000)).items():
            counts[b, k] = n
    return langid.Mixture(list(VOICES), counts)


def test_grams_equal_plain_counting():
    r = random.Random(2)
    for text in ["", None, "1 2 3", "a", "Ab", "É  è\n\tçx", "a-b c9d", "ß" * 40, "  x", *(words(r, "aa", 30) + " 7, " + words(r, "cc", 5) for _ in range(20))]:
        buckets, n = langid.gram_counts(text)
        assert dict(zip(buckets.tolist(), n.tolist())) == plain_grams(text or "")


def likelihood(model, grams, shares):
    total = sum(grams.values())
    return sum(n / total * math.log(sum(s * model.p[b, k] for k, s in shares.items())) for b, n in grams.items())


@pytest.mark.parametrize("parts", [("aa",), ("aa", "bb"), ("aa", "cc"), ("bb", "bb", "cc"), ("aa", "bb", "cc")])
def test_mixture_equals_a_grid_over_all_sets(model, parts):
    r = random.Random(len(parts))
    text = " ".join(words(r, p, 60) for p in parts)
    grams = plain_grams(text)
    weight = sum(grams.values()) / langid.OVERLAP
    cost = 0.5 * math.log(weight + 1) + 1
    best = (-math.inf, None)
    steps = 40
    for size in range(1, len(VOICES) + 1):
        for chosen in itertools.combinations(range(len(VOICES)), size):
            for cut in itertools.product(range(1, steps + 1), repeat=size - 1):
                last = steps - sum(cut)
                if last < 1:
                    continue
                shares = dict(zip(chosen, [c / steps for c in (*cut, last)]))
                value = weight * likelihood(model, grams, shares) - cost * (size - 1)
                best = max(best, (value, tuple(sorted(shares.items()))))
    name, score, shares = model.infer(text)
    got = {k: s for k, s in enumerate(shares) if s > 0}
    assert set(got) == {k for k, _ in best[1]}
    assert weight * likelihood(model, grams, got) - cost * (len(got) - 1) >= best[0] - 0.05
    assert all(abs(got[k] - s) < 1.5 / steps for k, s in best[1])
    assert name == list(VOICES)[max(got, key=got.get)] and 0 <= score <= 1

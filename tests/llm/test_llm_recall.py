from __future__ import annotations

import random
from collections import Counter

import pytest

from vocandra.llm.sketches import Signer


@pytest.mark.parametrize("n", [60, 120, 200, 400, 1000])
def test_alike_texts_share_a_key_at_any_length(n):
    """Words replaced all over texts in sentences of 20 words; similarities from 0.75 on."""
    rng = random.Random(n)
    words = ["w%d" % i for i in range(3000)]
    texts, pairs = [], 60 if n == 1000 else 200
    while len(texts) < 2 * pairs:
        a = [rng.choice(words) for _ in range(n)]
        share = rng.uniform(0.05, 0.3)
        b = [rng.choice(words) if rng.random() < share else w for w in a]
        if sum((Counter(a) & Counter(b)).values()) >= 0.75 * n:
            texts += [". ".join(" ".join(t[i : i + 20]) for i in range(0, n, 20)) for t in (a, b)]
    keys = [set(k) for k in Signer().sign(list(range(len(texts))), texts, [0] * len(texts))["keys"]]
    assert sum(bool(keys[i] & keys[i + 1]) for i in range(0, len(texts), 2)) >= 0.97 * pairs

"""Anchors of texts that are digested together, against a loop over their windows."""

import numpy as np
import pyarrow as pa

from panelforge.llm import repeats

LENGTH, GRAM = 24, 6


def by_loop(text: bytes) -> list[tuple]:
    """(gram, stretch, position, last, first) of each anchor, window by window."""
    found: dict[int, list[int]] = {}
    for start in range(len(text) - LENGTH + 1):
        digests = repeats.Digests(text[start:start + LENGTH]).grams(GRAM) >> np.uint64(32)
        found.setdefault(start + int(digests.argmin()), []).append(start)
    return [(text[at:at + GRAM], text[starts[0]:starts[-1] + LENGTH], at, at - starts[-1], at - starts[0]) for at, starts in found.items()]


def test_texts_digested_together_keep_their_own_anchors():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 97 + k % 4 + 1, n).astype(np.uint8)) for k, n in enumerate(rng.integers(0, 120, 60).tolist())]
    texts += [b"", b"ab" * 40, texts[3] + texts[5], b"x" * LENGTH, b"x" * (LENGTH - 1), None, b"a" * 300]
    raw, edges = repeats.flat(pa.array([b"skipped", *texts], pa.binary()).slice(1))
    texts = [t or b"" for t in texts]
    assert raw.tobytes() == b"".join(texts) and len(edges) == len(texts) + 1
    for cuts in ([(0, len(texts))], list(repeats.chunks(edges)), [(i, i + 1) for i in range(len(texts))]):
        got = []
        for a, b in cuts:
            text, gram, stretch, *places = repeats.owned(raw[edges[a]:edges[b]], edges[a:b + 1] - edges[a], LENGTH, GRAM)
            got += [(a + t, g, s, *p) for t, g, s, *p in zip(*(x.tolist() for x in (text, gram, stretch, *places)))]
        name = lambda part: int(repeats.Digests(part).of(np.array([0]), np.array([len(part)]))[0])
        want = [(i, int(repeats.Digests(g).grams(GRAM)[0]), name(s), *p) for i, t in enumerate(texts) for g, s, *p in by_loop(t)]
        assert sorted(got) == sorted(want)

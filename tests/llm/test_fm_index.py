import numpy as np

from cuewright.llm.fm_index import FMIndex


def test_search_and_locate_agree_with_a_scan():
    r = np.random.default_rng(1)
    for _ in range(100):
        runs = [r.integers(1, 4, r.integers(1, 12)) for _ in range(r.integers(1, 8))]
        runs += runs[:2]  # repeated runs
        text = np.concatenate([np.append(x, 0) for x in runs])
        index = FMIndex(text, 3)
        lengths = r.integers(1, 5, 20)
        patterns = np.zeros((20, 4), np.int64)
        for i, n in enumerate(lengths):
            patterns[i, :n] = r.integers(1, 4, n)
        low, high = index.search(patterns, lengths)
        for i, n in enumerate(lengths):
            got = sorted(index.locate(np.arange(low[i], high[i])).tolist())
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == patterns[i, :n]).all()]
            assert got == want

"""Parts that run without Spark, against plain re-statements."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import bpe, chunks, decontaminate, jaccard, langid, quality, suffixes, toxicity
from tidemark.llm.registry import vocabulary


@pytest.fixture(scope="module")
def codec():
    ranks, pattern = vocabulary()
    return bpe.Codec(ranks), pattern


def texts(seed, n):
    rng = random.Random(seed)
    alphabets = ["ab", "the ing er", "aaaa", "éèß中文 ", "0123 ", "   \n\t", " \x1c\x85", "'s're"]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([0, 1, 5, 60, 400])))


def test_bpe_equals_tiktoken(codec):
    import regex
    import tiktoken

    mine, pattern = codec
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=mine.ranks, special_tokens={})
    for text in [*texts(1, 400), "a" * 5000, "ab" * 3000, "中" * 700]:
        ids = [i for m in regex.findall(pattern, text) for i in mine.encode(m.encode())]
        assert ids == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_bpe_tree_equals_direct_merging(codec):
    for text in texts(2, 200):
        if text:
            assert codec[0].reduced(text.encode()) == codec[0].merged(text.encode())


def test_bpe_goes_through_the_tree(codec):
    """Words outside the vocabulary are joined from single bytes, and windows grow where the first one is not settled."""
    import regex

    counted = {"joined": 0, "window": 0}

    class Counting(bpe.Codec):
        def joined(self, left, right):
            counted["joined"] += 1
            return super().joined(left, right)

        def merged(self, piece):
            counted["window"] += len(piece) > 2
            return super().merged(piece)

    mine, plain = Counting(codec[0].ranks), 0
    for m in regex.findall(codec[1], "Herpulate gnifters wexel antidisestablishmentarianisms, 3.14159 -- zzzzzz\n\n\tquux"):
        before = counted["joined"]
        assert mine.encode(m.encode()) == codec[0].encode(m.encode())
        plain += counted["joined"] == before
    assert counted["joined"] > 50 and counted["window"] > 20 and plain > 3


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        width = rng.choice([1, 2, 4, 20, 400])
        s = np.array([rng.randint(1, width) for _ in range(rng.choice([1, 2, 3, 10, 200]))] + [0], "uint16")
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        sa = suffixes.suffix_array(s, width + 1)
        assert sa.tolist() == order
        _, length = suffixes.permuted_prefixes(s, sa)
        for a, b in zip(order, order[1:]):
            x, y = s[a:].tolist(), s[b:].tolist()
            assert length[b] == next((d for d in range(min(len(x), len(y))) if x[d] != y[d]), min(len(x), len(y)))


def test_suffixes_are_sorted_by_recursion(monkeypatch):
    """Over sample prose: the leftmost-smaller substrings of a shard are named and sorted as a string of their own, level by level."""
    raw = (" ".join(texts(9, 40)) + " the same passage again and again") * 3
    s = np.concatenate((np.frombuffer(raw.encode()[:20_000], "uint8").astype("uint16") + 2, [np.uint16(0)]))
    levels, plain = [], suffixes.suffix_array

    def counting(s, width):
        levels.append(len(s))
        return plain(s, width)

    monkeypatch.setattr(suffixes, "suffix_array", counting)
    order = counting(s, 258)
    tail = s.astype(">u2").tobytes()
    assert order.tolist() == sorted(range(len(s)), key=lambda i: tail[2 * i :])
    assert len(levels) >= 3 and all(2 * b <= a + 1 for a, b in zip(levels, levels[1:]))


def test_anchor_runs_cover_every_string_once():
    rng = random.Random(4)
    for raw in [bytes(rng.choice(b"ab") for _ in range(900)), b"a" * 700, bytes(rng.randrange(256) for _ in range(1500))]:
        anchor, first, last = suffixes.anchor_runs(raw)
        assert [s for a, b in zip(first, last) for s in range(a, b + 1)] == list(range(len(raw) - suffixes.LENGTH + 1))
        by_string = {}
        for h, a, b in zip(anchor.tolist(), first.tolist(), last.tolist()):
            for s in range(a, b + 1):
                assert by_string.setdefault(raw[s : s + suffixes.LENGTH], h) == h


def test_cut_points_survive_insertion():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh é") for _ in range(4000)).encode()
    cuts = lambda raw: {raw[a:b] for a, b in zip([0, *chunks.cut_points(raw)], chunks.cut_points(raw))}
    plain, moved = cuts(base), cuts(b"something new " + base)
    assert len(plain & moved) > 0.9 * len(plain)
    assert b"".join(base[a:b] for a, b in zip([0, *chunks.cut_points(base)], chunks.cut_points(base))) == base
    assert all(c.decode() is not None for c in plain)
    assert chunks.cut_points(b"") == [] and chunks.cut_points(b"abc") == [3] and max(np.diff(chunks.cut_points(b"a" * 9000))) <= chunks.LONGEST


def test_base_counts_restate_the_rules():
    for text in [*texts(6, 150), "a b c a b c d", "x\nx\n\n \nx", "a\x85b \x0b c"]:
        raw = text.encode()
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines, repeated = [], 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in lines
                lines.append(line)
        assert quality.base_counts(raw) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))


def test_jaccard_tokens_and_signatures():
    assert len(jaccard.tokens(b"", 3)) == 0 and len(jaccard.tokens(None, 3)) == 0
    assert len(jaccard.tokens(b"one two", 3)) == 1
    assert jaccard.tokens(b"one TWO", 3).tolist() == jaccard.tokens(b"ONE two", 3).tolist()
    rng = random.Random(7)
    for percent, wide in ((90, 120), (80, 120), (90, 900), (50, 60)):
        join = jaccard.Join(percent=percent, slots=1 << 10)
        classes = np.array([rng.choice([2, 5, 9, 14, 14, 15]) for _ in range(join.slots)], "uint8")
        linked = 0
        for _ in range(300):
            x = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(1, wide))], "uint64"))
            y = x[np.array([rng.random() > 0.6 * (1 - percent / 100) for _ in x])]
            y = np.unique(np.append(y, np.array([rng.getrandbits(64) for _ in range(rng.randint(0, 1 + len(x) // 25))], "uint64")))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and both < max(len(x), len(y)):
                linked += 1
                one, two = (dict(zip(*map(np.ndarray.tolist, jaccard.signatures(z, classes, 13, 15, join)[:2]))) for z in (x, y))
                close = [s for s in set(one) & set(two) if min(len(x) - one[s], len(y) - two[s]) * (100 + percent) >= percent * (len(x) + len(y))]
                assert close and jaccard.apart(jaccard.parities(x, join), jaccard.parities(y, join)) <= len(x) + len(y) - 2 * both
        assert linked > 60


def test_decontamination_words_and_runs():
    assert decontaminate.folded_words("A-b é_Ü 3x".encode()) == [b"a", b"b", "é".encode(), "Ü".encode(), b"3x"]
    assert decontaminate.long_runs(np.array([1, 1, 0, 1, 1, 1], bool), 2) == [(0, 2), (3, 6)]


def test_language_features_and_temperature():
    letters = langid.letter_table()
    assert langid.ngram_counts(None, letters, 1 << 10) is None and langid.ngram_counts("12 %", letters, 1 << 10) is None
    assert langid.ngram_counts("ab", letters, 1 << 10).sum() == 2 + 3 + 2
    logits = np.array([[2.0, 0.0], [2.0, 0.0], [2.0, 0.0], [0.0, 2.0]])
    assert langid.fitted_temperature(logits, np.array([0, 0, 1, 1])) > 1


def test_factorisation_machine_learns_a_pair():
    """Two terms that are toxic only together: the linear part alone cannot tell."""
    rng = random.Random(8)
    s = toxicity.Settings(buckets=64, l1=0.1, epochs=30, rounds=1, pair_rate=0.2)
    rows = []
    for _ in range(400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((np.array(([1] if a else [2]) + ([3] if b else [4])), int(a == b)))
    p = toxicity.Parameters(0.0, np.zeros(64), np.random.default_rng(1).normal(0, 0.1, (64, 4)))
    p = toxicity.fit_shard(rows, p, s)
    assert np.mean([(p.score(x) > 0) == y for x, y in rows]) > 0.95


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_seams_of_many_pairs_are_kept():
    from tidemark.llm.bpe import Codec

    codec = Codec({bytes([b]): b for b in range(256)})
    assert all(codec.pair(a, b) == [a, b] for a in range(256) for b in range(256))
    assert len(codec.seams) == 1 << 16

"""Operators without Spark: tokens, transforms, signatures, bins, models."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from cinelake.llm import jaccard, language, packing, suffix_dedup, toxicity, warc
from cinelake.llm.bpe import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def test_bpe_equals_the_library(encoder):
    t, r = Tokenizer.from_file(PATH), random.Random(1)
    signs = "abcdeosthing '!.,0129éèßñÉ\n\t<|>/w日ΣİاÁ"
    texts = ["", " ", "Hello, World!! it's 'street' x²", "a<|endoftext|>b <|startoftext|>", "a" * 3000, "日本語 ไทย İstanbul ΣΑΣ", "\x85a\xa0b\x1cc"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(500)]
    for text, (ids, decoded) in zip(texts, encoder.encode_and_decode(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == t.decode(want, skip_special_tokens=False) and encoder.decode(ids) == decoded


def test_bpe_of_every_code_point(encoder):
    """Each between two letters, the letters of newer versions of Unicode too."""
    t = Tokenizer.from_file(PATH)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 1 << 16):
        texts = [" ".join(f"a{c}b" for c in points[b : b + 512]) for b in range(a, min(a + (1 << 16), len(points)), 512)]
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_words_of_a_language_have_no_contractions():
    texts = ["'s", "3's", "12 'll 34", "\"'S=", "it's", "''", "7 '", "日's"]
    data, starts, ends, owner = language.words_of(texts)
    raw = data.tobytes()
    words = [[] for _ in texts]
    for a, b, k in zip(starts, ends, owner, strict=True):
        words[k].append(raw[a:b].decode())
    assert words == [["s"], ["s"], ["ll"], ["s"], ["it", "s"], [], [], ["日", "s"]]


def test_bins_hold_all_and_are_few():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 500):
        lengths = np.sort(r.integers(1, 101, n))[::-1]
        counts = np.bincount(lengths, minlength=101)
        table, bins = packing.plan_bins(counts, 100)
        used = np.zeros((bins, 100), int)
        for length in np.unique(lengths):
            own = table[table[:, 0] == length]
            for rank in range(counts[length]):
                _, first, repeats, bin_, at = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                copy, which = divmod(rank - first, repeats)
                start = at + copy * length
                assert start + length <= 100
                used[bin_ + which, start : start + length] += 1
        assert used.max(initial=0) <= 1 and used.sum() == lengths.sum()
        open_bins: list[int] = []  # first fit, longest first
        for length in lengths.tolist():
            for k, room in enumerate(open_bins):
                if room >= length:
                    open_bins[k] -= length
                    break
            else:
                open_bins.append(100 - length)
        assert bins <= len(open_bins)


def test_fullest_is_fullest():
    r = random.Random(2)
    for _ in range(200):
        items = {r.randint(1, 30): r.randint(1, 3) for _ in range(4)}
        room = r.randint(1, 60)
        sums = {0}
        for length, count in items.items():
            sums |= {s + length * k for s in sums for k in range(count + 1) if s + length * k <= room}
        chosen = packing.fullest(sorted(items.items(), reverse=True), room)
        assert sum(a * b for a, b in chosen) == max(sums) and all(b <= items[a] for a, b in chosen)


def test_signatures_miss_no_pair():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 8, 14, 30, 59, 61, 120, 700, 1500):
        for _ in range(20):
            x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            most = 2 * n // 7
            cut = int(r.integers(0, most + 1))
            kept = x[r.permutation(n)[cut:]]
            y = np.unique(np.concatenate([kept, r.integers(0, 2**64, (most - cut) if len(kept) else 1, dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            if len(y) == 0 or 100 * common < 75 * (len(x) + len(y) - common):
                continue
            sig, who = jaccard.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            assert np.intersect1d(sig[who == 0], sig[who == 1]).size, (len(x), len(y))


def test_links_within_connects_all_links():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 2**64, 80, dtype=np.uint64)) for _ in range(4)]
    sets = [np.sort(np.concatenate([b[r.permutation(80)[:75]], r.integers(0, 2**64, 4, dtype=np.uint64)])) for b in base for _ in range(8)]
    size = np.array([len(s) for s in sets])
    sketches = [np.frombuffer(jaccard.parity_sketch(s), np.uint64) for s in sets]
    root = list(range(len(sets)))
    for i, j in jaccard.links_within(size, sketches, sets, 75):
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 75 * (size[i] + size[j] - c):
                assert root[i] == root[j]


@pytest.mark.parametrize("depth", [3, 8, 11, 16, 25])
def test_merged_transforms_give_common_prefixes(depth):
    r = random.Random(depth)
    for _ in range(30):
        shards = [[bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 5))] for _ in range(r.randint(1, 4))]
        built = []
        for own in shards:
            data = np.frombuffer(b"".join(own), np.uint8)
            sizes = np.array([len(s) for s in own])
            ((_, bwt, order),) = suffix_dedup.transforms(data, np.cumsum(sizes) - sizes, sizes, np.zeros(len(own), np.int64))
            assert order.tolist() == list(range(len(own)))
            built.append(bwt)
        row, common, back, ends = suffix_dedup.merge(built, np.array([len(x) for x in shards]), depth)
        flat = [s for own in shards for s in own]
        string, offset = suffix_dedup.walk(back, ends, np.array([len(s) for s in flat]))
        got = [flat[string[k]][offset[k] :] for k in row]
        assert sorted(got) == sorted(s[i:] for s in flat for i in range(len(s) + 1))
        for place in range(1, len(got)):
            a, b = got[place - 1], got[place]
            n = 0
            while n < min(len(a), len(b), depth) and a[n] == b[n]:
                n += 1
            assert common[place] == n and (n == depth or a[n : n + 1] <= b[n : n + 1])
        # the shards' orders are kept: no suffix is sorted anew
        bounds = np.cumsum([0] + [len(x) for x in built])
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            assert np.all(np.diff(row[(row >= low) & (row < high)]) == 1)


def test_transforms_are_those_of_sorted_suffixes():
    r = random.Random(9)
    for _ in range(40):
        strings = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 40))) for _ in range(12)]
        group, sizes = np.array([r.randint(0, 3) for _ in strings]), np.array([len(s) for s in strings])
        for _, bwt, index in suffix_dedup.transforms(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes, group):
            # an end sorts before all bytes, and by the number of its string
            suffixes = sorted(([x + 100 for x in strings[i][o:]] + [k], strings[i][o - 1] + 1 if o else 0) for k, i in enumerate(index) for o in range(len(strings[i]) + 1))
            assert bwt.tolist() == [before for _, before in suffixes]


def test_fragments_agree_for_equal_windows():
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 300))) for _ in range(40)] + ["ab" * 100]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    found = suffix_dedup.fragments(data, offsets, 12, 5)
    seen, windows = {}, 0
    for start, n, mark in zip(found["start"].tolist(), found["windows"].tolist(), found["mark"].tolist(), strict=True):
        for k in range(start, start + n):
            windows += 1
            assert seen.setdefault(data[k : k + 12].tobytes(), mark) == mark
    assert windows == sum(max(0, len(t) - 11) for t in texts)
    by_mark = {}
    for i, mark in enumerate(found["mark"].tolist()):
        by_mark.setdefault(mark, []).append(i)
    for own in by_mark.values():
        run, start, n, second = suffix_dedup.second_marks(data, found["start"][own], found["windows"][own], 12, 5)
        assert np.bincount(run, weights=n).tolist() == found["windows"][own].tolist()
        seen = {}
        for a, m, s in zip(start.tolist(), n.tolist(), second.tolist(), strict=True):
            for k in range(a, a + m):
                assert seen.setdefault(data[k : k + 12].tobytes(), s) == s


def test_archives_are_checked():
    record = warc._record(7, "http://a", "é".encode(), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == "é".encode()
    for bad in (record[1:], record.replace(b"Content-Length: 2", b"Content-Length: 3"), record.replace("é".encode(), b"ab"), record[:-1]):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    packed = zstandard.ZstdCompressor(write_content_size=True).compress(record)
    assert list(warc.records(packed + warc.EMPTY_FRAME.encode("latin-1"))) == [record]
    with pytest.raises(ValueError):
        list(warc.records(packed[:-3]))


def _dictionary_bits(words, word, letters):
    """Bits of a word under interpolated Kneser-Ney models kept in dictionaries."""
    n, d = language.ORDER, language.DISCOUNT
    padded = lambda w: ["<"] * (n - 1) + list(w) + [">"]
    counts = [{} for _ in range(n + 1)]
    for w in words:
        s = padded(w)
        for i in range(n - 1, len(s)):
            gram = tuple(s[i - n + 1 : i + 1])
            counts[n][gram] = counts[n].get(gram, 0) + 1
    for k in range(n - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] = counts[k].get(gram[1:], 0) + 1
    bits, s = 0.0, padded(word)
    for i in range(n - 1, len(s)):
        p = 1 / letters
        for k in range(1, n + 1):
            gram = tuple(s[i - k + 1 : i + 1])
            followers = [c for g, c in counts[k].items() if g[:-1] == gram[:-1]]
            if followers:
                p = max(counts[k].get(gram, 0) - d, 0) / sum(followers) + d * len(followers) / sum(followers) * p
        bits -= np.log2(p)
    return bits


def test_language_models_are_those_of_dictionaries():
    r = random.Random(11)
    own = [["".join(r.choice(signs) for _ in range(r.randint(1, 7))) for _ in range(60)] for signs in ("abcd", "cdeé")]
    m = language.Models(own, ["x", "y"])
    assert m.letters == len(set("".join(own[0] + own[1]))) + 1
    words = [*own[0][:8], *own[1][:8], "zzz", "a", "dé"]
    size = np.array([len(w) for w in words])
    got = m.word_costs(np.array([ord(c) for w in words for c in w], np.uint64), size)
    want = [[_dictionary_bits(x, w, m.letters) for x in own] for w in words]
    assert np.allclose(got, want, rtol=1e-5)


def test_languages():
    texts = ["the cat sat on the mat", "le chat est sur la table", "the dog ran far away", "un chien court dans la rue"] * 5
    m = language.train(texts, ["en", "fr", "en", "fr"] * 5)
    asked = ["the cat", "la rue", "", "12 !", None or "", "<|endoftext|>", "the " * 5000, "la table"]
    best, score, _, _ = language.Scorer(m).predict(asked)
    got = [([*m.names, "und"])[b] for b in best]
    assert got[:5] == ["en", "fr", "und", "und", "und"] and got[5] != "und" and got[6:] == ["en", "fr"] and ((0 <= score) & (score <= 1)).all()
    tiny = language.Scorer(m, table_bytes=0)
    for _ in range(2):  # a small table, blocks of a few words, filled or not: the same
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(tiny.predict(asked, block=6), language.Scorer(m).predict(asked), strict=True))
    for nothing in (language.train([], []), language.train(["123", "456"], ["en", "en"])):
        assert language.Scorer(nothing).predict(["abc", ""])[0].tolist() == [-1, -1]


def _loop_logit(net, tokens, window):
    """One window's logit by plain loops over steps and units."""
    p, h = net.p, toxicity.HIDDEN
    x = []
    for t in window:
        row = np.searchsorted(net.words, tokens.hashes[t]) if tokens.hashes[t] in net.words else len(net.words)
        grams = tokens.grams[tokens.gram_starts[t] : tokens.gram_starts[t + 1]]
        x.append(np.concatenate([p["word"][row], p["char"][grams].mean(axis=0)]))
    sides = []
    for way, seq in ((0, x), (1, x[::-1])):
        state, states = np.zeros(h), []
        for v in seq:
            g, rec = v @ p["win"][way] + p["bin"][way], state @ p["rec"][way]
            z, r = (1 / (1 + np.exp(-(g[k : k + h] + rec[k : k + h]))) for k in (0, h))
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * rec[2 * h :])
            states.append(state)
        sides.append(states if way == 0 else states[::-1])
    both = [np.concatenate(s) for s in zip(*sides, strict=True)]
    score = np.array([np.tanh(s @ p["att"]) @ p["pick"] for s in both])
    weight = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    return sum(w * s for w, s in zip(weight, both, strict=True)) @ p["out"] + p["bias"][0]


def test_network_is_that_of_plain_loops_and_its_gradients_those_of_differences():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 5))) for _ in range(n)) for n in (1, 7, 40, 70)]
    t = toxicity.tokens_of(texts)
    net = toxicity.Network(np.sort(t.hashes[::2]), np.linspace(-1, 1, len(t.hashes[::2])))
    logit, start, text = net.window_logits(t)
    for k in range(len(start)):
        window = t.rows[start[k] : min(start[k] + toxicity.WINDOW, t.bounds[text[k] + 1])]
        assert abs(logit[k] - _loop_logit(net, t, window)) < 1e-4
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, index, weights = net.inputs(t, net.word_rows(t)), net.index(t, start, text), np.linspace(1, 2, len(start))
    _, memory = net.run(net.gates(x), index, keep=True)
    g, dx = net.gradients(x, index, memory, weights)
    value = lambda: float(net.run(net.gates(x), index) @ weights)
    for name, own, grad in [(k, net.p[k], g[k]) for k in ("win", "bin", "rec", "att", "pick", "out", "bias")] + [("x", x, dx)]:
        for at in [tuple(int(q) for q in np.unravel_index(i, own.shape)) for i in np.random.default_rng(1).integers(0, own.size, 6)]:
            kept = own[at]
            own[at] = kept + 1e-2
            up = value()
            own[at] = kept - 1e-2
            down = value()
            own[at] = kept
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-3 * max(1, abs(grad[at])), name


def test_network_learns_and_windows_cover():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    texts = [" ".join([word() for _ in range(60)] + (["nasty"] if i % 3 == 0 else []) + [word() for _ in range(20)]) for i in range(120)]
    net = toxicity.train(texts, [int(i % 3 == 0) for i in range(120)])
    score, count, _ = net.score([*texts, "", "x"])
    assert np.mean((score[:120] >= 0.5) == [i % 3 == 0 for i in range(120)]) > 0.97
    assert count[120] == 0 and 0 <= score[120] <= 1 and count[121] == 1
    start, _ = toxicity.windows_of(np.array([0, 81]))
    assert start.tolist() == [0, 16, 32, 48, 64] and toxicity.train([], []).score(["a"])[0][0] == 0


def test_shingles():
    flat, bounds = jaccard.shingle_sets(pa.array(["A b c d e f", "a B c d e f", "", "x", "a a a a a a a a"], pa.large_string()))
    sets = [set(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [2, 2, 0, 1, 1]

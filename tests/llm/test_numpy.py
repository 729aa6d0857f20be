"""The array code against plain Python."""

import bisect
import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scrollweave.llm import bestfit_pack, bytewise, dart_minhash, huffman_ids, language_spans, quality_votes, suffix_windows, tokens

TEXTS = ["", " ", "a b", "\n\n a\x1cb", "ab  c", "x ", " y  z\t\tq", "don't I'll  !!", "日本語 テスト café  naïve　x <|endoftext|> a", "end ", None, "to be " * 30, "line one\nline one\n\nline one \nx", "Aa " * 8 + "b " + "Aa " * 8, "ÀÉ ñ ß 😀 !? #$%", "a" * 300]


def test_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    made = tokens.Encoder(tokens.default_path())
    got = []
    for _, _, text in bytewise.chunks(pa.array(TEXTS), 64):
        ids, edge = made.encode(text)
        got += [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids + [tokens.END_ID] for x in TEXTS]


@pytest.fixture
def poor_hashes(monkeypatch):
    """Hashes of two bits, so that almost all things share theirs with others."""
    hashes = bytewise.Text.hashes
    monkeypatch.setattr(bytewise.Text, "hashes", lambda self, a, b: hashes(self, a, b) & np.uint64(3))


def test_pieces_that_share_a_hash(poor_hashes):
    test_tokens_are_the_librarys()


def test_bytes_that_are_no_text():
    from tokenizers import Tokenizer

    raw = [b" a b " + b"\xff" * 3 + b" c d", " né ok".encode() * 50, b" \xc3x y", b"x" + " wörd".encode() * 300 + b" \xe2\x82 z"]
    text = bytewise.Text(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    ids, edge = tokens.Encoder(tokens.default_path()).encode(text)
    plain = Tokenizer.from_file(tokens.default_path())
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [plain.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids + [tokens.END_ID] for x in raw]


def test_lines_and_words_that_share_a_hash(poor_hashes):
    test_quality_counts()


def test_long_pieces_whose_polynomials_are_the_same():
    from tokenizers import Tokenizer

    word = "a"
    for _ in range(11):
        word += word.translate({97: "b", 98: "a"})
    twin = word.translate({97: "b", 98: "a"})
    text = f"{word} {twin} {twin} {word}\n{twin}"
    ids, _ = tokens.Encoder(tokens.default_path()).encode(next(bytewise.chunks(pa.array([text])))[2])
    assert ids.tolist() == Tokenizer.from_file(tokens.default_path()).encode(text, add_special_tokens=False).ids + [tokens.END_ID]
    m = quality_votes.measure(next(bytewise.chunks(pa.array([f"{word}\n{twin}"])))[2])
    assert m["n_dup_lines"].tolist() == [0]


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 63, 64, 65, 300])
def test_codes_of_ranges(size):
    rng = np.random.default_rng(size)
    raw = [bytes(rng.integers(97, 99, max(0, size - int(rng.integers(0, 2))), np.uint8)) for _ in range(60)] + [b"x" * size] * 3
    text = bytewise.Text(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    code, first, _ = text.codes(text.offsets[:-1], text.offsets[1:])
    assert all((code[i] == code[j]) == (raw[i] == raw[j]) for i in range(len(raw)) for j in range(i)) and all(code[f] == k for k, f in enumerate(first))


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = {}
    for i in range(len(words) - 7):
        found.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {k for at in found.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover)]


def test_quality_counts():
    got = []
    for _, _, text in bytewise.chunks(pa.array(TEXTS), 100):
        m = quality_votes.measure(text)
        got += np.stack([m[f] for f in quality_votes.FEATURES[:5]], 1).tolist()
    assert got == [plain_counts(t) for t in TEXTS]


def plain_em(votes, start, strength, rounds=3000):
    """(posterior of each document, penalised likelihood): EM as in the books, one document at a time."""
    post = [0.99 if sum(v == 0 for v in d if v is not None) < start else 0.01 for d in votes]
    rules, n, q = range(len(votes[0])), len(votes), quality_votes
    for _ in range(rounds):
        prior = (sum(post) + strength * q.GOOD) / (n + strength)
        rate = [[(sum(p * d[r] for p, d in zip(w, votes, strict=True) if d[r] is not None) + strength * believed) / (sum(p for p, d in zip(w, votes, strict=True) if d[r] is not None) + strength) for believed, w in ((1 - q.MISFIRE, post), (1 - q.HIT, [1 - p for p in post]))] for r in rules]
        new, like = [], 0.0
        for d in votes:
            a, b = prior, 1 - prior
            for r in rules:
                if d[r] is not None:
                    a *= rate[r][0] if d[r] else 1 - rate[r][0]
                    b *= rate[r][1] if d[r] else 1 - rate[r][1]
            new.append(a / (a + b))
            like += math.log(a + b)
        moved, post = max(abs(x - y) for x, y in zip(new, post, strict=True)), new
        if moved < 1e-10:
            break
    like += strength * (q.GOOD * math.log(prior) + (1 - q.GOOD) * math.log(1 - prior) + sum(b * math.log(x) + (1 - b) * math.log(1 - x) for r in rate for b, x in zip((1 - q.MISFIRE, 1 - q.HIT), r, strict=True)))
    return post, like


def votes_of(n, seed=0, rules=5, misfire=0.02, hit=0.6):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        good = rng.random() < 0.8
        out.append(tuple(None if rng.random() < 0.2 else int(rng.random() >= (misfire if good else hit)) for _ in range(rules)))
    return out


def learned(votes, strength=quality_votes.STRENGTH):
    patterns = collections.Counter(votes)
    matrix = np.array([[np.nan if v is None else v for v in p] for p in patterns], float)
    return quality_votes.learn(matrix, np.array(list(patterns.values()), float), strength)


def posterior_of(model, votes):
    start, weights = model.weights()
    return 1 / (1 + math.exp(-start - sum(w[v == 0] for w, v in zip(weights, votes, strict=True) if v is not None)))


@pytest.mark.parametrize("strength", [2.0, 20.0])
def test_em_gives_the_posteriors_of_a_plain_one(strength):
    votes = votes_of(400)
    model = learned(votes, strength)
    want, _ = max((plain_em(votes, start, strength) for start in (1, 2, 3)), key=lambda x: x[1])
    assert max(abs(posterior_of(model, v) - p) for v, p in zip(votes, want, strict=True)) < 1e-3


def test_votes_are_learned():
    model = learned(votes_of(20000))
    assert abs(model.prior - 0.8) < 0.03
    assert all(abs(1 - good - 0.02) < 0.01 and abs(1 - bad - 0.6) < 0.06 for good, bad in model.told)
    beliefs = quality_votes.learn(np.zeros((0, 3)), np.zeros(0))
    assert beliefs.prior == quality_votes.GOOD and len(beliefs.told) == 3


def test_rule_that_errs_on_many_good_texts_is_outvoted():
    names = [r.name for r in quality_votes.RULES]
    votes = lambda *bad: tuple(0 if n in bad else 1 for n in names)
    junk = ("symbols", "symbol_words", "letter_words", "letters")
    own = [(votes(), 8000), (votes(*junk), 700), (votes(*junk[:3]), 100)]
    for scale in (1, 100):
        for rule in ("sentences", "function_words", "capitals", "symbols"):
            for n in (0, 5, 3000):
                found = [*own, (votes(rule), n)]
                model = quality_votes.learn(np.array([v for v, _ in found], float), np.array([c * scale for _, c in found], float))
                assert posterior_of(model, votes(rule)) > 0.5 > posterior_of(model, votes(*junk[:3]))


def best_fit_decreasing(sizes):
    gaps, used = [], 0
    for size in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, size)
        gap = gaps.pop(i) if i < len(gaps) else 1024
        used += gap == 1024
        if gap > size:
            bisect.insort(gaps, gap - size)
    return used


def test_packing_is_tight():
    """As tight as best fit in decreasing order, within 1 %."""
    rng = np.random.default_rng(0)
    for size in (rng.integers(1, 1025, 3000), rng.integers(1, 400, 3000), np.full(10, 1024), np.ones(5000, int)):
        size = np.sort(size)[::-1]
        at, offset = bestfit_pack.sum_of_squares(size)
        used = np.bincount(at, size)
        assert used.max() <= 1024 and len(used) <= best_fit_decreasing(size.tolist()) * 1.01
        for k in np.unique(at)[:50]:
            own = at == k
            order = np.argsort(offset[own])
            assert (offset[own][order] == np.cumsum(size[own][order]) - size[own][order]).all()


def plain_sum_of_squares(sizes, capacity):
    """Each piece where the sum over gaps of the squared number of open sequences becomes smallest; of equals the smallest gap; of sequences with that gap the latest."""
    gaps, out, ends = [], [], []
    for size in sizes:
        best = None
        for gap in sorted({g for g in gaps if g >= size}):
            count = collections.Counter(g for g in gaps if g > 0)
            count[gap] -= 1
            if gap > size:
                count[gap - size] += 1
            cost = sum(n * n for n in count.values())
            if best is None or cost < best[0]:
                best = (cost, gap)
        if best is None:
            gaps.append(capacity - size)
            ends.append(len(out))
            out.append((len(gaps) - 1, 0))
        else:
            at = max((i for i, g in enumerate(gaps) if g == best[1]), key=lambda i: ends[i])
            ends[at] = len(out)
            out.append((at, capacity - gaps[at]))
            gaps[at] -= size
    return out


@pytest.mark.parametrize("seed", range(12))
def test_sum_of_squares_against_plain(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, (33, 17, 9)[seed % 3], 120)
    sizes = np.sort(sizes)[::-1] if seed % 2 else sizes
    at, offset = bestfit_pack.sum_of_squares(sizes, 32)
    assert list(zip(at.tolist(), offset.tolist(), strict=True)) == plain_sum_of_squares(sizes.tolist(), 32)


def plain_votes(text):
    """The votes of quality_votes.RULES from the text as characters."""
    q, text = quality_votes, text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_words, chars, symbols, dup, repeat = plain_counts(text)
    letter = lambda c: c.isascii() and c.isalpha() or c >= "\xc0" or "\x80" <= c
    big, small = re.findall("[A-Z\u00c0-\u00de]", text), re.findall("[a-z\u00df-\u00ff]", text)
    have = {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": len(lines),
        "n_twice": sum(a == b for a, b in zip(words, words[1:])), "n_upper": len(big), "n_letters": len(big) + len(small), "n_shouts": text.count("!"),
        "n_ends": sum(w[-1] in ".?!" for w in words), "n_symbol_words": sum(bool(re.search(r"[#*$%&|<>]", w)) for w in words), "n_letter_words": sum(any(map(letter, w)) for w in words),
        "n_capital_words": sum(sum("A" <= c <= "Z" for c in w) >= 2 and sum("A" <= c <= "Z" for c in w) == sum(map(letter, w)) for w in words),
        "n_distinct": len(set(words)), "n_function_words": sum(w in f for w in words) if (f := {x for w in q.FUNCTION_WORDS for x in (w, w.capitalize())}) else 0, "n_letter_chars": sum(map(letter, "".join(words))),
    }
    out = []
    for rule in q.RULES:
        top, bottom = have[rule.top], have[rule.bottom]
        if bottom < rule.least:
            out.append(None)
            continue
        good, bad = (top / bottom <= rule.good, top / bottom >= rule.bad) if rule.good < rule.bad else (top / bottom >= rule.good, top / bottom <= rule.bad)
        out.append(1 if good else 0 if bad else None)
    return tuple(out)


@pytest.mark.parametrize("counts", [[0, 5], [1, 1, 0, 2], [3 ** (i % 30) for i in range(400)], [1] * 5000])
def test_huffman_round_trip(counts):
    counts = np.array(counts)
    lengths = huffman_ids.code_lengths(counts, 14)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= 14 and (2.0**-used).sum() <= 1 and ((lengths > 0) == (counts > 0)).all()
    ids = np.repeat(np.flatnonzero(counts), np.minimum(counts[counts > 0], 7)).astype(np.uint32)
    np.random.default_rng(1).shuffle(ids)
    block = huffman_ids.write_block([3, None], np.array([1, len(ids) - 1]), ids, 9, lengths, huffman_ids.canonical(lengths), 16)
    keys, sizes, back, before = huffman_ids.Decoder(lengths).read(block)
    assert (keys, sizes.tolist(), before) == ([3, None], [1, len(ids) - 1], 9) and (back == ids).all()


def test_lengths_are_optimal_without_a_limit():
    import heapq

    rng = np.random.default_rng(2)
    counts = rng.integers(1, 1000, 60)
    heap, total = sorted(counts.tolist()), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert (huffman_ids.code_lengths(counts, 30) * counts).sum() == total


@pytest.mark.parametrize("kind", ["set", "real"])
def test_signatures_agree_as_often_as_sets_overlap(kind):
    rng = np.random.default_rng(0)
    n, size = 300, 3000
    keys = bytewise.mix(np.arange(1, n + 1, dtype=np.uint64))
    a = rng.integers(0, 2, n) * (1.0 if kind == "set" else 1.7)
    b = np.where(rng.random(n) < 0.85, a, rng.integers(0, 2, n) * (1.0 if kind == "set" else 0.6))
    k, d, w = np.concatenate([keys[a > 0], keys[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([a[a > 0], b[b > 0]])
    sign = dart_minhash.signatures(k, d, w, 3, size)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign[0] == sign[1]).mean() - want) < 4 * (want * (1 - want) / size) ** 0.5 + 0.005
    assert (sign[2] == 0).all() and (sign[:2] != 0).all()


def plain_viterbi(scores, penalty):
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        jump = value.max() - penalty
        back.append(np.where(value >= jump, np.arange(len(value)), value.argmax()))
        value = np.maximum(value, jump) + row
    return value.max()


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(150):
        count = rng.integers(0, 30, 6)
        docs = np.repeat(np.arange(6), count)
        scores = np.repeat(rng.normal(0, 1.5, (40, 3)), 5, 0)[: len(docs)]
        state = language_spans.viterbi(scores, docs, 6, 2.0)
        for d in np.flatnonzero(count):
            own, s = state[docs == d], scores[docs == d]
            assert s[np.arange(len(own)), own].sum() - 2.0 * (own[1:] != own[:-1]).sum() == pytest.approx(plain_viterbi(s, 2.0))


def test_mixed_text_has_spans():
    text = {"xx": "the cat sat on the mat and the dog ran " * 40, "yy": "привет мир это русский текст для проверки " * 40, "zz": "der hund und die katze sind nicht auf dem dach " * 40}
    counts = {}
    for lang, t in text.items():
        words = language_spans.Words(bytewise.Text(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))
        by = np.bincount(words.grams, minlength=1 << 16) + np.bincount(words.whole, minlength=1 << 16)
        counts[lang] = (by, np.bincount(words.script, words.size, len(language_spans.SCRIPTS)).astype(int))
    model = language_spans.Model.of(counts)
    mixed = ("the dog and the cat ran on the mat " * 3 + "это русский мир " * 3 + "die katze und der hund sind auf dem dach " * 3).encode()
    words = language_spans.Words(bytewise.Text(np.frombuffer(mixed, np.uint8), np.array([0, len(mixed)])))
    state = language_spans.viterbi(language_spans.word_scores(words, model), words.docs, 1)
    assert [model.languages[k] for k in dict.fromkeys(state.tolist())] == ["xx", "yy", "zz"]
    assert (np.diff(state) != 0).sum() == 2


def plain_words(text):
    import unicodedata

    kinds = [unicodedata.category(c)[0] for c in text]
    found = [(m.start(), m.end()) for m in re.finditer("[LM]+", "".join(k if k in "LM" else "." for k in kinds))]
    return [(a, b) for a, b in found if "L" in kinds[a:b]]


def test_words_have_a_letter():
    texts = ["\u0301", "\U000f0000", "a\u0301b \u0301 \u0302\u0301c", "\U00020000\U00030000", "1 2", "\U000e0100", "привет\u0301, x", "\U0001e900"]
    for t in texts:
        words = language_spans.Words(next(bytewise.chunks(pa.array([t])))[2])
        assert list(zip(words.begin.tolist(), (words.begin + words.size).tolist(), strict=True)) == plain_words(t)
        assert len(words.grams) == sum(b - a for a, b in plain_words(t))


def plain_removed(texts, ids, depth):
    low = {}
    for t, i in zip(texts, ids, strict=True):
        for s in range(len(t) - depth + 1):
            low[t[s : s + depth]] = min(low.get(t[s : s + depth], i), i)
    out = []
    for t, i in zip(texts, ids, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - depth + 1):
            if low[t[s : s + depth]] < i:
                gone[s : s + depth] = True
        out.append(gone)
    return out


def test_radix_groups():
    data = np.frombuffer(b"abcabcabcabcabcabcxyzabcabcabcabcabcabc", np.uint8)
    place = np.arange(len(data) - 16 + 1)
    group = suffix_windows.radix(suffix_windows.words_at(data), place, np.zeros(len(place), np.int64), 16)
    raw = data.tobytes()
    for i in place:
        same = [j for j in place if raw[j : j + 16] == raw[i : i + 16]]
        assert (group[i] >= 0) == (len(same) > 1) and all(group[j] == group[i] for j in same)


def test_sorted_ranges():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 400, np.uint8)
    data[200:320] = data[40:160]
    start, size, key = rng.integers(0, 340, 600), rng.integers(8, 60, 600), rng.integers(0, 3, 600).astype(np.uint64)
    start[300:], size[300:], key[300:] = start[:300] % 100 + 40, 50, 1
    start[450:] = start[300:450] + 160
    codes = suffix_windows.sorted_ranges(suffix_windows.words_at(data), start, size, key)
    what = [(k, data[a : a + n].tobytes()) for k, a, n in zip(key.tolist(), start.tolist(), size.tolist(), strict=True)]
    assert len(set(zip(what, codes.tolist(), strict=True))) == len(set(what)) == len(set(codes.tolist()))


def test_crc_is_of_four_byte_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")

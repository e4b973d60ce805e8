"""Spelling variants, phrases and mixes against plain Python."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty_like, odd_documents, prose  # noqa: E402

from wickerwork.llm import mixing, phrases, spelling  # noqa: E402

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling

def vocabulary(docs, one_in, least=5):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least and len(w) >= 6}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(docs, one_in):
    words = vocabulary(docs, one_in)
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def spelled(df, one_in):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, one_in=one_in).collect()}


def test_spelling_equals_all_pairs(spark):
    rng = random.Random(8)
    letters = "abcéÿA"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(120)]
    words += ["banana" * 3, "aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "x" * 400, "x" * 401]
    words += [w[:i] + rng.choice(letters) + w[i + d:] for w in words[:60] for i, d in [(rng.randrange(len(w)), rng.randrange(2))]]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(200))) + "-éàç9") for i in range(120)]
    docs += [(None, "banana" * 3 + " banana-banana"), (7, None), (8, "")]
    want = by_hand(docs, 7)
    assert sum(f is not None for f, *_ in want.values()) > 20
    assert spelled(spark.createDataFrame(docs, "doc_id long, text string"), 7) == want


def test_chains_of_forms(spark):
    text = " ".join(["letters"] * 900 + ["lettrs"] * 160 + ["lettxs"] * 30 + ["letxxs"] * 6)
    got = spelled(spark.createDataFrame([(1, text)], "doc_id long, text string"), 1 << 40)
    assert {w: r[:2] for w, r in got.items()} == {"letters": (None, "letters"), "lettrs": ("letters", "letters"), "lettxs": ("lettrs", "letters"),
                                                 "letxxs": ("lettxs", "letters")}


def test_spelling_of_odd_tables(spark):
    docs = odd_documents(spark)
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], 199)
    assert spelled(docs, 199) == want
    assert spelling.spelling_variants(empty_like(docs)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, length=5)


@pytest.mark.parametrize("seed", range(4))
def test_an_edit_touches_no_more_grams_than_the_bound(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = "abcd"[:rng.choice([2, 3, 4])]
        frequent = {a + b for a in "^" + letters for b in letters if rng.random() < 0.6}
        frequent |= {g + c for g in list(frequent) for c in letters if rng.random() < 0.6}
        for _ in range(40):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
            at, gone = rng.randrange(len(word)), rng.randrange(2)
            other = word[:at] + rng.choice(["", *letters]) + word[at + gone:]
            if len(other) < 6 or not one_apart(word, other):
                continue
            places, grams = spelling.decompose(word, frequent)
            found = set(zip(*spelling.decompose(other, frequent)))
            moved = len(other) - len(word)
            shared = sum((i, g) in found or (i + moved, g) in found for i, g in zip(places, grams))
            assert shared >= len(grams) - spelling.most_touched(places, grams) >= 1


def test_the_dictionary_is_bounded(spark):
    words = spark.createDataFrame([("".join(p) + "zz",) for p in itertools.product("abcde", repeat=5)], "word string")
    assert {len(g) for g in spelling.frequent_grams(words)} == {2, 3}
    few = spelling.frequent_grams(words, most=10)
    assert 0 < len(few) <= 20


# phrases

def phrases_by_hand(docs, most, minimum, first):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(A_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= minimum}
        hidden = {q for p, a in good.items() for size in range(2, len(p)) for i in range(len(p) - size + 1)
                  for q in [p[i:i + size]] if a >= counts[q]}
        rows = []
        for p, a in good.items():
            if p not in hidden:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("block_words", [40, 1 << 20])
def test_phrases_equal_counting(spark, block_words):
    rng = random.Random(2)
    fixed = ["red green blue", "one two three four five six", "A a a a", "é\x01 ü"]
    docs = []
    for i in range(150):
        words = [rng.choice([*fixed, *"abcde", "rare%d" % rng.randrange(500), ".", "\n", "\t", ";"]) for _ in range(rng.randrange(60))]
        docs.append((i, rng.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    docs += [(1, "en", None), (2, "fr", ""), (3, "en", "  . ,"), (3, "en", "  . ,")]
    want = phrases_by_hand([d[1:] for d in docs], 5, 6, 40)
    assert {len(p[2].split()) for p in want} == {2, 3, 4, 5}
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3)
    got = phrases.collocations(df, minimum=6, first=40, block_words=block_words)
    assert sorted(tuple(r[f] for f in FIELDS) for r in got.collect()) == want


def test_phrases_of_odd_tables(spark):
    docs = odd_documents(spark)
    want = phrases_by_hand([(r.lang, r.text) for r in docs.collect()], 5, 3, 2000)
    assert sorted(tuple(r[f] for f in FIELDS) for r in phrases.collocations(docs, minimum=3).collect()) == want != []
    assert phrases.collocations(empty_like(docs)).count() == 0
    assert phrases.collocations(docs, minimum=1 << 30).count() == 0


def test_products_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("array(9000000000000L, 7000000000001L) AS begins", "array(8000000000003L, 7000000000001L) AS ends", "90000000000007L AS n")
    cut = row.selectExpr(f"{phrases.lowest_cut()} AS c").first().c
    assert cut.score == 1000 * 7000000000001 * 90000000000007 // (9000000000000 * 8000000000003)


@pytest.mark.parametrize("dense", [1, 300, 1 << 40])
def test_tiles_count_all_pairs(monkeypatch, dense):
    monkeypatch.setattr(phrases, "DENSE", dense)
    rng = np.random.default_rng(5)
    x, y = rng.zipf(1.3, 20_000) % 9000, rng.zipf(1.2, 20_000) % 70_000
    a, b, c = phrases.tile_counts(x, y)
    assert dict(zip(zip(a.tolist(), b.tolist()), c.tolist())) == Counter(zip(x.tolist(), y.tolist()))
    assert [len(p) for p in phrases.tile_counts(x[:0], y[:0])] == [0, 0, 0]


# mixing

def mix_by_hand(docs):
    rows = []
    for doc_id, source, text in docs:
        size = len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
        runs = len(re.findall("[A-Za-zÀ-ÿ]{3,}", text or ""))
        u = (int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        quality = 0.05 + 0.95 * min(1, runs / size) if size else 1.0
        rows.append((-math.log(u) / quality, doc_id is not None, doc_id or 0, size, source))
    sizes = Counter()
    for r in rows:
        sizes[r[-1]] += r[3]
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        total = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / total for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sizes:
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        left = math.floor(target[s] - epochs * sizes[s])
        for key, _, doc_id, size, _ in sorted(r for r in rows if r[-1] == s):
            out.append((doc_id, size, sizes[s], round(target[s], 6), epochs * size + max(0, min(size, left))))
            left -= size
    return sorted(out)


def mixed(df):
    return sorted((r.doc_id or 0, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_sources(df).collect())


def test_mixes_equal_plain_sampling(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["big"] * 30 + ["a", "b", "c", "d", None]), prose(i, rng.randrange(60)) + " %%" * rng.randrange(9)) for i in range(400)]
    docs += [(1000, "blank", None), (1001, "blank", ""), (None, "b", "no id here"), (5, "b", "twice"), (5, "b", "twice")]
    got = mixed(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    assert got == mix_by_hand(docs)
    assert {round(t / s, 3) for _, _, s, t, _ in got if s} > {3.0}
    totals = defaultdict(int)
    for _, _, s, t, n in got:
        totals[s, t] += n
    assert all(abs(n - t) <= 1 for (s, t), n in totals.items())


def test_mixes_of_odd_tables(spark):
    docs = odd_documents(spark)
    assert mixed(docs) == mix_by_hand([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert mixing.mix_sources(empty_like(docs)).count() == 0
    none = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.mix_sources(none).collect()] == [(0.0, 0), (0.0, 0)]


def test_mixes_repeat(spark):
    docs = spark.createDataFrame([(i, "s", prose(i, 30)) for i in range(200)] + [(900, "t", prose(4, 3000))], "doc_id long, source string, text string")
    assert mixed(docs) == mixed(docs.repartition(7)) and {r[4] for r in mixed(docs)} > {0}

"""Operators that look at one text at a time, against plain Python."""

import hashlib
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty_like, labels_of, odd_documents, prose  # noqa: E402

from wickerwork.llm import decontamination, line_dedup, pii, quality, quality_rules, toxicity  # noqa: E402


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def by_pattern(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_personal_data_equals_patterns(spark):
    rng = np.random.default_rng(3)
    alphabet = list("aB0123459.@+-  ()%_x\né")
    texts = ["".join(rng.choice(alphabet, size=int(rng.integers(0, 80)))) for _ in range(1500)]
    texts += [None, "", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (212) 555-0100 x", "x" * 5000 + "@y.zz" * 50,
              "9" * 6000, "1.1.1." + "0" * 5000 + "7"]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = by_pattern(texts[r.doc_id])
        counts = Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PATTERNS)
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert r.spans[:len(digest)] == digest


def test_personal_data_own_kinds(spark):
    text = "see https://user@host.example.org/a?b=1, IBAN: DE89 3704 0044 0532 0130 00 or account no. 12345678; discount 12345678, account of 2020"
    finder = pii.Finder()
    found = {k: [text[a:b] for a, b in v] for k, v in finder.spans(text).items()}
    assert found["address"] == ["https://user@host.example.org/a?b=1"]
    assert found["account"] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    docs = spark.createDataFrame([(1, "to a@b.cd now"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["to <email> now", None]


# benchmark decontamination

def folded(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def leaked(text, items, window=10):
    doc, hit, found = folded(text), set(), set()
    for item, body in items:
        w = folded(body)
        size = min(window, len(w))
        grams = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(doc) - size + 1 if w else 0):
            if tuple(doc[i:i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_decontamination_equals_windows(spark, block_words):
    rng = np.random.default_rng(5)
    draw = lambda n, k: " ".join(f"w{x}" for x in rng.integers(0, k, n))
    items = [(i, draw(int(rng.integers(1, 40)), 3)) for i in range(12)] + [(12, "W1 w2, W1-w1"), (13, None), (14, " ... "), (15, "w1"), (16, draw(30, 400)), (17, draw(12, 400))]
    items.append((18, items[16][1]))
    docs = [(i, draw(int(rng.integers(0, 120)), 4)) for i in range(40)] + [(40, None), (41, ""), (42, "x " + items[16][1] + " y"), (43, "é " + items[17][1].upper())]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                                        block_words=block_words).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == leaked(dict(docs)[r.doc_id], items), r.doc_id


def test_leaked_passages_are_cut(spark):
    item = prose(7, 30)
    docs = odd_documents(spark)
    more = spark.createDataFrame([(20, f"before {item}. after", "en", "s", 1), (21, item, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(more, allowMissingColumns=True)
    out = decontamination.decontaminate(both, spark.createDataFrame([(1, item)], "item_id long, text string"), max_coverage=0.95)
    assert out.columns == both.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[20].text == "before . after" and rows[20].n_chars == 14
    assert 21 not in rows and rows[1].text is None and rows[1].n_chars == -1 and len(out.collect()) == 11
    none = decontamination.decontaminate(both, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 12


def test_cuts_do_not_depend_on_blocks(spark):
    one, two, free = ([f"{c}{i}" for i in range(60)] for c in "abf")
    items = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(two[:5] + free[:9]))]
    inner = one[20:26] + two[3:17] + one[26:33]  # taking the second item out joins a window of the first
    texts = {1: free[:40] + one[:30] + free[:40] + two[:30], 2: free[:20] + one[:30] + free[20:40] + two[:30], 3: free[:30] + inner + free[:30],
             4: free[:30] + one[5:35] + free[30:60], 5: two[:5] + free[:30], 6: free[:40] + one[:5] + free[:40], 7: one}
    docs = spark.createDataFrame([(i, " ".join(t), -1) for i, t in texts.items()] + [(8, None, -1), (4, " ".join(texts[4]), -1)], "doc_id long, text string, n_chars long")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(tuple, decontamination.decontaminate(docs, table, block_words=n).collect()), key=repr) for n in (60, 200_000)]
    assert got[0] == got[1]
    rows = {i: (t, n) for i, t, n in got[0]}
    assert {1, 3, 4, 5, 6, 8} == set(rows) and len(got[0]) == 7
    assert rows[3] == (" ".join([*free[:30], "", *free[:30]]), len(" ".join([*free[:30], "", *free[:30]]))) and rows[8] == (None, -1)
    assert rows[6] == (" ".join(texts[6]), -1)


# quality rules

def base(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules(spark):
    rng = np.random.default_rng(11)
    texts = ["\n".join(" ".join(f"w{x}" for x in rng.integers(0, int(k), int(n))) for _ in range(3)) for n, k in zip(rng.integers(0, 60, 80), rng.integers(1, 90, 80))]
    texts += [None, "", " \n ", prose(1, 30_000), ("# " + prose(2, 60)) * 3, prose(3, 100).upper(), "\n".join([prose(4, 60)] * 4), "😀 " * 60 + "a|b", " ".join(f"v{i % 90}" for i in range(300))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] == base(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert texts.index(prose(1, 30_000)) in kept and texts.index(prose(3, 100).upper()) not in kept
    assert quality_rules.quality_rules(empty_like(docs)).count() == 0


def test_cascade_order_is_rejection_per_cost(spark):
    rules = [quality_rules.Rule(n, lambda t: F.lit(True)) for n in "abc"]
    chain = quality_rules.cascade([(rules[0], 0.5, 1.0), (rules[1], 0.4, 0.1), (rules[2], 0.0, 0.01)])
    assert spark.createDataFrame([("x",)], "text string").select(chain.alias("first")).first()[0] == "b"


# line dedup

def test_boilerplate_lines(spark):
    rows = [(i, "\n".join(["  menu ", f"own {i}", "menu", f"shared {i // 2}", ""]), "h") for i in range(20)]
    rows += [(100 + i, f"menu\nown {i}", "other") for i in range(4)] + [(200, None, "h"), (201, "menu", "h"), (202, "", None)]
    docs = spark.createDataFrame([(i, t, s, len(t or ""), "x") for i, t, s in rows], "doc_id long, text string, source string, n_chars int, line string")
    out = line_dedup.drop_boilerplate(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert got[3].text == "own 3\nshared 1\n" and got[3].n_chars == len(got[3].text)
    assert got[101].text == "menu\nown 1"  # four pages are too few to tell
    assert got[200].text is None and got[201].text == "" and got[202].text == ""
    assert line_dedup.drop_boilerplate(empty_like(docs)).count() == 0
    assert line_dedup.drop_boilerplate(odd_documents(spark)).count() == 10


# classifiers

def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    good = np.array(labels) == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    bad = ["zorg", "blarg", "fnord", "quux"]
    rows, labels = [], []
    for i in range(1200):
        text, toxic = prose(i, 60), int(rng.random() < 0.15)
        if toxic:
            text += " ".join(["", *rng.choice(bad, 2)]).title() + "!"
        rows.append((i, text))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    out = toxicity.toxicity_scores(docs, labels_of(spark, [*labels, labels[5], (6, None, None), (None, 1, 1)])).toPandas()
    assert len(out) == 1200 and (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out]
    truth = [labels[i][2] for i in held.doc_id]
    assert auc(held.score.to_numpy(), truth) > 0.97
    assert held.predicted[np.array(truth) == 1].mean() > 0.9 and held.predicted[np.array(truth) == 0].mean() < 0.05


def test_toxicity_risk_is_not_negative():
    few, many = toxicity.Rows([np.array([0])] * 5), toxicity.Rows([np.array([1])] * 95 + [np.array([0])] * 5)
    w, b = toxicity.train_nnpu(few, many, 2, 0.05, seed=1)
    p = lambda i: 1 / (1 + np.exp(-w[i] - b))
    assert p(0) > 0.5 > 0.3 > p(1)


def test_quality_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        rows.append((i, ". ".join(prose(i * 7 + j, 12) for j in range(6)) if good else prose(i, 60).upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x"))
    known = labels_of(spark, labels)
    out = quality.quality_scores(docs, known).toPandas()
    held = out[out.held_out]
    assert len(out) == 900 and auc(held.score.to_numpy(), [labels[i][1] for i in held.doc_id]) > 0.99
    assert ((held.score >= 0.5) == (held.predicted == 1)).all() and (held.predicted == [labels[i][1] for i in held.doc_id]).mean() > 0.97
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and abs(kept.count() - 600) < 15


def test_normal_equations_sum_over_partitions(spark):
    stats = np.random.default_rng(0).normal(size=(50, quality.N_STATS))
    train = spark.createDataFrame([(s.tolist(), float(i % 2)) for i, s in enumerate(stats)], "stats array<double>, label double").repartition(7)
    project = quality.Projection(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), features=8)
    gram, moment = quality._normal_equations(train, project)
    z = project(stats)
    assert np.allclose(gram, z.T @ z) and np.allclose(moment, z.T @ (np.arange(50) % 2))


def test_isotonic():
    assert quality.isotonic(np.ones(5), np.array([0, 2, 1, 1, 5])).tolist() == [0, 4 / 3, 4 / 3, 4 / 3, 5]


@pytest.mark.parametrize("labels", [[], [(3, 1, 1), (4, 0, 0), (None, None, None)]])
def test_odd_tables(spark, labels):
    docs, known = odd_documents(spark), labels_of(spark, labels)
    items = spark.createDataFrame([(None, None), (2, "one")], "item_id long, text string")
    for table, n in ((docs, 10), (empty_like(docs), 0)):
        for out in (pii.find_pii(table), quality_rules.quality_rules(table), decontamination.contamination(table, items), line_dedup.drop_boilerplate(table)):
            assert out.count() == n
        for out in (toxicity.toxicity_scores(table, known), quality.quality_scores(table, known)):
            rows = out.collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)


# columns whose names are taken

def test_taken_names_are_kept(spark):
    names = ["_redacted", "_ww_clean", "_ww_cut", "_ww_kept", "_ww_score", "_text_bytes", "_ww_host", "_t"]
    docs = odd_documents(spark)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.lit(n) for n in names})
    items = spark.createDataFrame([("i", prose(2, 30))], "item_id string, text string")
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(9)])
    for made in (pii.redact(docs), line_dedup.drop_boilerplate(docs), decontamination.decontaminate(docs, items), quality.keep_good(docs, labels)):
        assert made.columns == docs.columns
        assert all(r[n] == n for r in made.collect() for n in names)


def test_costs_are_those_of_rules(spark):
    docs = spark.createDataFrame([(i, prose(i, 3000)) for i in range(200)], "doc_id long, text string")
    costs = {r.name: cost for r, _, cost in quality_rules.measure(docs)}
    assert max(costs["short_words"], costs["long_words"], costs["symbols"]) < costs["letters"]

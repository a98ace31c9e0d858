"""Training-data operators against brute force, round trips and held-out accuracy, with nulls, empties, ties, repeats and extra columns."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import blocks, chat_format, decontaminate, embedding_index, fill_middle, html_text, language_id, mixing, packing, quality, queries, simhash, similar_texts, spelling, store, suffix_array, suffix_dedup, toxicity
from ledgerlens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, size int, fp string, label double, score string"


def docs(spark, rows):
    """(doc_id, text[, lang, source]) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *["en", "s"][len(r) - 2 :], len(r[1] or ""), "x", 9, "f", 0.5, "z") for r in rows], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- suffix arrays and dedup


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 250):
        for _ in range(40):
            texts = [rng.integers(0, k, rng.integers(0, 30)).astype(np.uint8) for _ in range(rng.integers(1, 5))]
            t, _ = suffix_array.join(texts)
            order = suffix_array.suffix_array(t, len(texts))
            letters = t.tolist()
            assert order.tolist() == sorted(range(len(letters)), key=lambda i: letters[i:])
            phi, prefix = suffix_array.common_prefixes(t, order, 32)
            for before, i in zip(order[:-1], order[1:]):
                n = 0
                while max(i, before) + n < len(t) and t[i + n] == t[before + n]:
                    n += 1
                assert phi[i] == before and prefix[i] == n


def test_suffix_array_of_names():
    rng = np.random.default_rng(9)
    for k in (1, 2, 5, 400):
        for _ in range(60):
            texts = [rng.integers(0, k, rng.integers(0, 60)) for _ in range(rng.integers(1, 5))]
            if rng.random() < 0.4:
                texts.append(np.tile(texts[0], 4))
            _, dense = np.unique(np.concatenate(texts), return_inverse=True)
            texts = np.split(dense, np.cumsum([len(x) for x in texts])[:-1])
            t, _ = suffix_array.join(texts)
            letters = t.tolist()
            assert suffix_array.of_names(t).tolist() == sorted(range(len(letters)), key=lambda i: letters[i:])


def brute_repeats(texts, width):
    seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2, 10_000])
def test_suffix_dedup(spark, group):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared, other = word(60), word(45)
    rows = [(i, word(rnd.randrange(0, 80)) + (shared if i % 2 else other) + word(rnd.randrange(0, 80))) for i in range(24)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "a" * 200), (104, rows[0][1]), (104, rows[0][1]), (None, rows[3][1][:70]), (105, shared + shared)]
    got = suffix_dedup.repeats(docs(spark, rows), suffix_dedup.Unit(False, 40, 12), group=group, shard=500)
    want = brute_repeats([(t or "").encode() for _, t in rows], 40)
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()))) == sorted(map(str, ((i, *w) for (i, _), w in zip(rows, want))))
    kept = suffix_dedup.remove(docs(spark, rows), suffix_dedup.Unit(False, 40, 12), group=group)
    assert kept.columns == docs(spark, rows).columns
    assert by_id(kept)[102].text == "short" and 104 not in by_id(kept)


def thue_morse(level, a, b):
    """A word and its complement, which every polynomial hash modulo a power of two takes for equal."""
    for _ in range(level):
        a, b = a + b, b + a
    return a, b


def test_agreement_is_told_by_letters():
    rng = np.random.default_rng(3)
    t = rng.integers(0, 2, 500)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    size = rng.integers(0, 100, 300)
    want = [next((k for k in range(n) if t[i + k] != t[j + k]), n) for i, j, n in zip(a.tolist(), b.tolist(), size.tolist())]
    for most in (1, 50, 1 << 20):
        assert suffix_array.agree(t, a, b, size, most).tolist() == want


def test_suffix_arrays_of_texts_that_hash_alike():
    """Common prefixes and order of Thue-Morse words: only letters tell them apart."""
    words = [np.frombuffer(w.encode(), np.uint8) for level in (4, 9, 10) for w in thue_morse(level, "ab", "ba")]
    t, _ = suffix_array.join([*words, words[2][100:900], np.concatenate(words[:4])])
    order = suffix_array.suffix_array(t, 8)
    letters = t.tolist()
    assert order.tolist() == sorted(range(len(letters)), key=lambda i: letters[i:])
    phi, prefix = suffix_array.common_prefixes(t, order, len(t), 16)
    for before, i in zip(order[:-1].tolist(), order[1:].tolist()):
        n = 0
        while max(i, before) + n < len(t) and t[i + n] == t[before + n]:
            n += 1
        assert phi[i] == before and (prefix[i] == n or prefix[i] <= n < 16)


@pytest.mark.parametrize("group", [2, 5000])
def test_dedup_keeps_texts_that_hash_alike(spark, group):
    """At the contract's sizes: words and their complements lose nothing to each other, real repeats go."""
    rnd = random.Random(17)
    a, b = thue_morse(9, "+", "2")
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = noise(700)
    rows = [(1, a), (2, b), (3, noise(300) + a[:450]), (4, noise(900) + shared + noise(40)), (5, shared[100:650] + noise(500)), (6, shared[:399]), (7, "z" * 1500), (8, noise(200) + a + noise(10) + b), (9, thue_morse(8, "+", "2")[0] * 3)]
    got = by_id(suffix_dedup.repeats(docs(spark, rows), group=group))
    want = dict(zip([i for i, _ in rows], brute_repeats([t.encode() for _, t in rows], 400)))
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    assert by_id(suffix_dedup.repeats(docs(spark, rows[:2])))[1].n_removed == 0


def test_passages_keep_texts_that_hash_alike(spark):
    rnd = random.Random(18)
    words = lambda n: [rnd.choice(["a", "bb", "ccc", "x-y"]) + str(rnd.randrange(50)) for _ in range(n)]
    lead, (a, b) = words(50), thue_morse(10, "a", "b")
    rows = [(1, " ".join([*lead[:25], a, *lead[25:]])), (2, " ".join([*lead[:25], b, *lead[25:]])), (3, " ".join(words(30) + lead + words(9))), (4, "\n".join(lead + ["end"])), (5, " ".join(lead + ["end"])), (6, " ".join(words(60)))]
    want = brute_passages([t for _, t in rows], 51)
    kept = by_id(suffix_dedup.remove(docs(spark, rows), suffix_dedup.WORDS))
    for (i, _), (w, gone) in zip(rows, want):
        left = [x for x, g in zip(w, gone) if not g]
        assert (kept[i].text.split() if i in kept else []) == left
    assert set(kept) == {1, 2, 3, 6}


def brute_passages(texts, width):
    """Words of each text in runs of ``width`` words that also start elsewhere."""
    words = [re.findall("[^\x20\x09-\x0d]+", t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    return [(w, [any(seen[tuple(w[i : i + width])] > 1 for i in range(max(0, j - width + 1), min(j, len(w) - width) + 1)) for j in range(len(w))]) for w in words]


@pytest.mark.parametrize("group", [2, 10_000])
def test_repeated_passages_of_words(spark, group):
    """Runs of words, whatever their white space, also at unequal width in bytes; every byte of the rest stays."""
    rnd = random.Random(21)
    word = lambda n: [rnd.choice(["a", "bb", "éé", "dddd", "e" * rnd.choice([1, 9]), "x-y"]) for _ in range(n)]
    join = lambda w: "".join(x + rnd.choice([" ", " ", "\n", " \t"]) for x in w)
    shared, other = word(25), word(14)
    texts = [join(word(rnd.randrange(0, 40)) + (shared if i % 2 else other) + word(rnd.randrange(0, 40))) for i in range(24)]
    texts += [None, "", " \n", "short", "w " * 300, join(shared[3:16]), join(shared + shared), texts[0], "p" * 30 + " " + join(other)]
    rows = list(enumerate(texts))
    unit = suffix_dedup.Unit(True, 12, 4)
    want = brute_passages([t or "" for t in texts], 12)
    df = docs(spark, [*rows, (40, texts[3]), (40, texts[3])])
    want_all = brute_passages([t or "" for _, t in [*rows, (40, texts[3]), (40, texts[3])]], 12)
    got = by_id(suffix_dedup.repeats(df, suffix_dedup.Unit(False, 40, 12), passages=unit, group=group, shard=300))
    assert [got[i].n_passage_words for i, _ in rows] == [sum(g) for _, g in want_all[: len(rows)]]
    kept = by_id(suffix_dedup.remove(docs(spark, rows), unit, group=group))
    for (i, t), (w, gone) in zip(rows, want):
        left = [x for x, g in zip(w, gone) if not g]
        if any(gone):
            assert (re.findall("[^\x20\x09-\x0d]+", kept[i].text) if left else i not in kept) == (left or True)
        else:
            assert kept[i].text == t


def test_no_passage_of_over_fifty_words_is_left():
    """The stage's unit: whatever windows of 51 words two texts share, their anchors are equal."""
    rnd = random.Random(22)
    word = lambda n: ["".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 9))) for _ in range(n)]
    unit, shared = suffix_dedup.WORDS, word(51)
    roller = suffix_dedup.Roller(1000)
    seen = [set().union(*(set(key.tolist()) for _, _, key, _ in suffix_dedup.regions(np.frombuffer(unit.encode(" ".join(word(30) + shared + word(n))), np.uint8), roller, unit))) for n in (0, 10, 200)]
    assert seen[0] & seen[1] & seen[2]


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.repeats(docs(spark, []), passages=suffix_dedup.WORDS).count() == 0
    assert suffix_dedup.remove(docs(spark, []), suffix_dedup.WORDS).count() == 0


def test_suffix_dedup_of_one_line_many_times(spark):
    """A text that is one long line over and over is one row for each region, and goes whole."""
    line = " ".join(f"word{i}" for i in range(70)) + "\n"
    df = docs(spark, [(1, line * 4000), (2, "head " + line * 3 + "tail"), (3, None)])
    got = by_id(suffix_dedup.repeats(df, passages=suffix_dedup.WORDS))
    assert got[1].n_removed == got[1].n_bytes == 4000 * len(line) and got[1].n_spans == 1 and got[1].n_passage_words == 4000 * 70
    assert got[2].n_passage_words == 210 and got[3].n_passage_words == 0
    unit = suffix_dedup.WORDS
    rows = pd.concat(suffix_dedup._anchored(unit)(iter([pd.DataFrame({"h1": [1], "h2": [2], "dk": [3], "text": [line * 4000]})])))
    assert len(rows) < 300 and rows["n"].sum() > 4000
    left = by_id(suffix_dedup.remove(df, unit))
    assert set(left) == {2, 3} and left[2].text == "head tail" and left[3].text is None


def test_common_prefixes_above_a_bound():
    rng = np.random.default_rng(4)
    for _ in range(60):
        texts = [rng.integers(0, 2, rng.integers(0, 60)).astype(np.uint8) for _ in range(4)]
        t, _ = suffix_array.join([*texts, np.tile(texts[0], 3)])
        order = suffix_array.suffix_array(t, 5)
        _, every = suffix_array.common_prefixes(t, order, 512)
        _, some = suffix_array.common_prefixes(t, order, 512, 6)
        assert ((every >= 6) == (some >= 6)).all() and (some[every >= 6] == every[every >= 6]).all()


def test_sieve_lets_no_match_out(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"), "id")
    wanted = rows.where("id % 7 = 0").select(F.col("h").alias("w"))
    assert store.sieve(rows, ["h"], wanted).where("id % 7 = 0").count() == 429
    assert store.sieve(rows, ["h"], wanted, out=True).where("id % 7 = 0").count() == 0
    assert store.sieve(rows, ["h"], wanted).count() + store.sieve(rows, ["h"], wanted, out=True).count() == 3000
    assert store.sieve(rows, ["h"], wanted.limit(0)).count() == 0


# --- decontamination


def brute_best(text, item):
    """The best stretch over every alignment, without seeds."""
    hashed = decontaminate.Hasher()
    ids, own = hashed(text), hashed(" ".join(item))
    return decontaminate.best(ids, own, range(-len(own), len(ids) + 1))


def test_decontamination(spark):
    """Every overlap of 15 tokens with three substituted is found, and what is found is what all alignments give."""
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate((3, 9, 12, 16, 30, 40))]
    rows, want = [], {}
    for i, item in items:
        for _ in range(20):
            copy = list(item)
            if len(copy) >= 10:
                for p in rnd.sample(range(len(copy)), min(len(copy), 15) // 5):
                    copy[p] = "changed"
            rows.append((len(rows), " ".join([*text(20), *copy, *text(20)]).upper()))
            want[rows[-1][0]] = i
    rows += [(len(rows) + k, " ".join(text(200))) for k in range(40)]
    # stretches of an item, with substitutions, insertions and two items in one text
    for _ in range(40):
        part = list(items[5][1][rnd.randrange(0, 20) :])
        for p in rnd.sample(range(len(part)), rnd.randrange(0, 5)):
            part[p] = "other"
        if rnd.random() < 0.5:
            part.insert(rnd.randrange(len(part)), "inserted")
        rows.append((len(rows), " ".join([*text(5), *part, *text(3), *items[rnd.randrange(6)][1]])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = collections.defaultdict(dict)
    for r in decontaminate.overlaps(docs(spark, rows), bench).collect():
        got[r.doc_id][r.item_id] = (r.start, r.length, r.matched)
        assert r.similarity == r.matched / r.length
    assert all(i in got[d] for d, i in want.items())
    for d, t in rows:
        for i, item in items:
            brute = brute_best(t, item)
            if i in got[d]:
                assert got[d][i] == brute
            else:  # what has no seed is no overlap of 15 tokens with a fifth substituted
                assert brute is None or brute[2] < 0.8 * brute[1] or brute[1] < min(15, len(item))


def test_decontamination_cases(spark):
    rnd = random.Random(2)
    text = lambda n: [f"w{rnd.randrange(500)}" for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate((3, 9, 12, 16, 30, 40))]
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items), (7, None), (8, ""), (9, "... !"), (None, " ".join(items[4][1])), (5, " ".join(items[5][1]))], "item_id long, text string").withColumn("h1", F.lit("x"))
    long = " ".join(f"q{i % 977}" for i in range(200_000))
    rows = [(1, "x " + " ".join(items[5][1])), (1, "x " + " ".join(items[5][1])), (2, None), (3, ""), (4, " ".join(text(100))), (None, " ".join(items[4][1])), (5, long + " " + " ".join(items[3][1])), (6, long)]
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.overlaps(docs(spark, rows), bench).collect())
    assert got == sorted([("1", "5")] * 4 + [("None", "4"), ("None", "None"), ("5", "3")])
    kept = decontaminate.clean(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6] and kept.columns == docs(spark, rows).columns
    assert decontaminate.clean(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.clean(docs(spark, []), bench).count() == 0 and decontaminate.overlaps(docs(spark, []), bench).count() == 0


def test_token_hashes_survive_a_full_cache(monkeypatch):
    monkeypatch.setattr(decontaminate, "CACHE", 10)
    hashed, plain = decontaminate.Hasher(), decontaminate.Hasher
    for t in ("a b c d e f", "g h a b i j k l", "a m n o p q r s t u v w x y z", "", None):
        assert hashed(t).tolist() == plain()(t).tolist()


# --- language


def test_language_id(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and runs ", "le renard brun saute par dessus le chien paresseux été "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 3), "en" if i % 2 else "fr") for i in range(8)] + [(20, None, "en"), (21, "12 34 !", "fr"), (22, "the dog", None), (23, "Le Chien été", None), (24, "", "en")]
    df = docs(spark, rows)
    model = language_id.learn(df)
    assert set(model) == {"en", "fr"}
    got = by_id(language_id.predict(df, model))
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(8))
    assert [got[i].lang_pred for i in (20, 21, 22, 23, 24)] == ["und", "und", "en", "fr", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.predict(df, {}).collect()} == {"und"}


def test_language_counts_by_brute_force(monkeypatch):
    text = "Élan vital—l'été! a bc " * 20

    def brute():
        out = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out.update(w)
            padded = f"\1{w}\1"
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    want = brute()
    for block in (1 << 19, 16):
        monkeypatch.setattr(language_id, "BLOCK", block)
        keys, n = language_id.count(text)
        got = {}
        for k, c in zip(keys.tolist(), n.tolist()):
            s = ""
            while k:
                s, k = chr(k & 0x1FFFFF) + s, k >> 21
            got[s] = c
        assert got == want


def test_language_by_brute_force(spark):
    """Out-of-place distances and the choice, on whole texts; of equally near languages the first name, with no rows too."""
    rnd = random.Random(16)
    langs = {"aa": "abcab", "bb": "bcdbc", "cc": "xyzab"}
    rows = [(i, " ".join("".join(rnd.choices(letters, k=rnd.randrange(1, 7))) for _ in range(60)), lang) for i, (lang, letters) in enumerate(list(langs.items()) * 12)]
    df = docs(spark, rows)
    size = 40
    profiles = language_id.learn(df, size)

    def top(texts):
        n = collections.Counter()
        for t in texts:
            for k, c in zip(*(x.tolist() for x in language_id.count(t))):
                n[k] += c
        return [k for k, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:size]]

    want = {lang: top(t for _, t, own in rows if own == lang) for lang in langs}
    assert {k: list(v) for k, v in profiles.items()} == want
    got = by_id(language_id.predict(df, profiles, size))
    for i, t, _ in rows:
        own = top([t])
        far = {lang: sum(abs(p.index(g) - r) if g in p else size for r, g in enumerate(own)) for lang, p in want.items()}
        assert got[i].lang_pred == min(sorted(far), key=far.get)
        assert got[i].score == pytest.approx(1 - min(far.values()) / (size * len(own)))
    tie = language_id.Ranker({"zz": want["aa"], "aa": want["aa"]}, size)
    assert tie.predict("abc abc")[0] == "aa"
    assert language_id.predict(docs(spark, []), profiles).count() == 0 and language_id.learn(docs(spark, [])) == {}
    long = "abcab " * 200_000
    assert language_id.Ranker(profiles, size).predict(long)[0] == "aa"


# --- mixing


def test_mixing_by_brute_force(spark):
    """Targets by the rule itself, and multiples: every document a whole number of times, at most three; also a very long text."""
    rnd = random.Random(17)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 3, 40])), "en", rnd.choice(["a", "b", "b", "c", "d", None])) for i in range(400)] + [(900, "w " * 300_000, "en", "b"), (901, None, None, "e")]
    got = mixing.mix(docs(spark, rows)).collect()
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(size.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    assert all(r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] for r in got)
    assert {(r.doc_id, r.size) for r in got} == {(i, len((t or "").split())) for i, t, _, _ in rows}
    assert all(r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] for r in got)



def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 2, 5, 30, 200])), "en", rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(700, None, "en", "a"), (701, "", "en", "b"), (702, "x y", "en", "d"), (702, "x y", "en", "d"), (None, "x", "en", "a")]
    for bucket in (16, 4096):
        got = mixing.mix(docs(spark, rows), bucket=bucket).collect()
        assert len(got) == len(rows)
        size, taken, target = collections.Counter(), collections.Counter(), {}
        for r in got:
            assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
            size[r.source] += r["size"]
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert target["d"] == pytest.approx(3 * size["d"])
        assert sum(target.values()) == pytest.approx(sum(size.values()))
        assert all(abs(taken[s] - target[s]) <= 210 for s in target)
        again = mixing.mix(docs(spark, rows).repartition(3), bucket=bucket).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_splits_equal_rows(spark, monkeypatch):
    """Twenty thousand rows equal in everything, without an id: many buckets, none too large, and the target met."""
    fly = mixing._fly

    def small(seed):
        inner = fly(seed)

        def run(group):
            assert len(group) < 1500, len(group)
            return inner(group)

        return run

    monkeypatch.setattr(mixing, "_fly", small)
    many = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    some = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("t").alias("source"))
    got = mixing.mix(many.unionByName(some), bucket=1000).groupBy("source", "taken").agg(F.count("*").alias("n"), F.max("target").alias("target")).collect()
    for source, size in (("s", 3), ("t", 2)):
        rows = [r for r in got if r.source == source]
        assert sum(r.n for r in rows) == {"s": 20_000, "t": 900}[source]
        assert abs(sum(r.n * r.taken for r in rows) - rows[0].target) <= 2 * size and all(r.taken <= 3 * size for r in rows)
    twins = mixing.numbered(many.select("doc_id", "source", F.lit(3).alias("size")))
    assert twins.agg(F.count("*"), F.countDistinct("twin"), F.max("twin")).first() == (20_000, 20_000, 19_999)


def test_flight_keeps_totals():
    rnd = random.Random(3)
    sizes = [float(rnd.choice([1, 1, 7, 90])) for _ in range(200)]
    p = [0.37] * 200
    left = mixing.flight(p, sizes, rnd)
    assert len(left) <= 2 and sum(p) == pytest.approx(74) and sum(a * b for a, b in zip(p, sizes)) == pytest.approx(0.37 * sum(sizes))


# --- toxicity and quality


def labelled(n=300):
    rnd = random.Random(4)
    plain = ["tree", "river", "stone", "cloud", "walk", "green", "light"]
    rows, toxic, good = [], [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(10, 60))]
        t, q = i % 3 == 0, i % 4 != 1
        if t:
            for _ in range(rnd.randrange(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "scum"]))
        rows.append((i, " ".join(w) if q else "!!! ".join(w) + "!!!"))
        toxic.append(int(t))
        good.append(int(q))
    return rows, toxic, good


def test_toxicity(spark):
    rows, toxic, _ = labelled()
    labels = spark.createDataFrame([*((i, t) for i, t in enumerate(toxic) if i < 200), (5, None), (None, 1)], "doc_id long, toxic int")
    df = docs(spark, rows + [(900, None), (901, ""), (902, "... 12")])
    got = by_id(toxicity.score(df, toxicity.train(df, labels)))
    held = range(200, 300)
    assert sum((got[i].p_toxic >= 0.5) == bool(toxic[i]) for i in held) >= 97
    assert all(0 <= got[i].p_toxic <= 1 and 0 <= got[i].expected_severity <= 3 for i in got) and got[900].p_toxic < 0.5
    none = toxicity.train(df, labels.limit(0))
    assert {r.severity for r in toxicity.score(df, none).collect()} == {0}


def test_severity_follows_the_rate_of_marked_words(spark):
    """Of texts that are as long, those with more marked words are graded higher; as many in a longer text weigh less. Very long, repeated and doubled rows."""
    rows, toxic, _ = labelled()
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    plain = ["tree", "river", "stone", "cloud", "walk", "green", "light"] * 10
    mixed = lambda marked, n: " ".join((["idiot"] * marked + plain * 40)[:n])
    odd = [(1000 + k, mixed(k, 40)) for k in range(6)] + [(1010, mixed(5, 2000)), (1011, "idiot tree " * 300_000), (0, rows[0][1]), (0, "idiot " + rows[0][1])]
    df = docs(spark, rows + odd)
    got = collections.defaultdict(list)
    for r in toxicity.score(df, toxicity.train(df, labels)).collect():
        got[r.doc_id].append(r)
    level = [got[1000 + k][0].expected_severity for k in range(6)]
    assert level == sorted(level) and level[5] > level[1] > level[0]
    assert got[1010][0].expected_severity < level[5] < 3 and got[1011][0].severity == 3
    assert len(got[0]) == 3 and got[0][0].p_toxic in {r.p_toxic for r in got[0]}
    assert toxicity.score(docs(spark, []), toxicity.train(docs(spark, []), labels)).count() == 0


def test_severity_gradient_descends():
    """The fit reaches a lower loss than the thresholds alone, and grades are thirds of the rates."""
    rng = np.random.default_rng(1)
    rows, toxic = [], []
    for i in range(300):
        bad = 1 + i // 60 if i % 3 == 0 else 0
        counts = {1: bad, **{2 + int(k): 1 for k in rng.integers(0, 40, 20)}}
        rows.append((np.array([k for k, n in counts.items() if n]), np.array([n for n in counts.values() if n])))
        toxic.append(int(bad > 0))
    grades = toxicity.grade(rows, np.array(toxic))
    assert set(grades[np.array(toxic) == 0]) == {0} and {1, 2, 3} == set(grades[np.array(toxic) == 1])
    order = [grades[i] for i in range(0, 300, 3)]
    assert np.mean(order[:20]) < np.mean(order[-20:])
    m = toxicity.fit(rows, np.array(toxic))

    def loss(weight):
        z = np.array([sum(weight * m.weights.get(int(k), 0) * v for k, v in zip(i, toxicity.rates(c))) for i, c in rows])
        f = np.c_[np.zeros(300), toxicity._sigmoid(m.thresholds - z[:, None]), np.ones(300)]
        return -np.log(np.maximum(f[np.arange(300), grades + 1] - f[np.arange(300), grades], 1e-12)).mean()

    assert loss(1) < 0.6 * loss(0)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    rows = [(np.array([1, 2 + i % 50]), np.array([1 + (i % 4) * 3 if i % 4 else 1, 1])) if i % 4 else (np.array([2 + i % 50]), np.array([1])) for i in range(200)]
    m = toxicity.fit(rows, np.array([int(i % 4 > 0) for i in range(200)]))
    assert (np.diff(m.thresholds) > 0).all() and m.weights[1] > 0
    del rng


def test_quality(spark):
    rows, _, good = labelled()
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good) if i < 200], "doc_id long, label int")
    df = docs(spark, rows + [(900, None), (901, ""), (902, "x" * 5000)])
    net = quality.train(df, labels)
    got = by_id(quality.score(df, net))
    assert sum((got[i].score >= 0.5) == bool(good[i]) for i in range(200, 300)) >= 97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert quality.train(df, labels.limit(0)).score("any") == 0.5
    assert quality.score(docs(spark, []), net).count() == 0
    assert quality.train(docs(spark, []), labels).score("any") == 0.5


def test_quality_fit_reads_whole_texts(spark):
    """Every byte of a labelled text is in some chunk, and a repeated doc_id teaches once."""
    text = "".join(chr(33 + i % 90) for i in range(5000))
    rows = pd.DataFrame({"doc_id": [1, 2, 3], "text": [text, "", "short"], "label": [1.0, 0.0, 1.0]})
    got = pd.concat(quality._cut_chunks(iter([rows])))
    size = quality.CHUNK + quality.WIDTH - 1
    chunks = [np.frombuffer(c, "<i2") for c in got["chunk"][got["doc_id"] == 1]]
    assert all(len(np.frombuffer(c, "<i2")) == size for c in got["chunk"])
    whole = np.concatenate([chunks[0][: quality.HALF], *(c[quality.HALF : 2 * quality.HALF] for c in chunks[:-1]), chunks[-1][quality.HALF :]])
    assert bytes(whole[: len(text)].astype(np.uint8)) == text.encode() and set(whole[len(text) :].tolist()) <= {quality.NONE}
    df = docs(spark, [(1, "good text " * 9)] * 50 + [(2, "bad!!! " * 9)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    seen = []
    real = quality.fit
    quality.fit = lambda x, y, doc, **k: seen.append(len(y)) or real(x, y, doc, **k)
    try:
        quality.train(df, labels)
    finally:
        quality.fit = real
    assert seen == [2]


def test_quality_sees_every_byte():
    net = quality.Network(1)
    b = quality.to_bytes("a" * 20_000)
    base = net.pooled(b)
    for at in (0, 511, 9000, 19_999):
        changed = b.copy()
        changed[at] = 200
        assert (net.pooled(changed) != base).any()
    r = net.responses(b[:700])
    assert np.allclose(net.pooled(b[: 512 + quality.WIDTH - 1])[0], r[:512].max(0))


def test_quality_gradient():
    net = quality.Network(2)
    rng = np.random.default_rng(3)
    b, y, w = rng.integers(0, 256, (6, 40)).astype(np.int16), rng.integers(0, 2, 6).astype(float), np.ones(6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.logits(net.responses(b).max(1))
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.step(b, y, w)
    for name in net.p:
        flat, gf = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(gf))[:3]:
            old, eps = flat[i], 1e-6
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(gf[i], abs=1e-5)


# --- near duplicates


def brute_fingerprint(text, shingle):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    runs = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("bits, segments", [(3, 2), (5, 3)])
def test_simhash(spark, bits, segments):
    rnd = random.Random(6)
    base = [rnd.choice("abcdefgh") * 2 + str(rnd.randrange(50)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "One"), (5, "one"), (6, "two words")]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = "changed" + str(rnd.randrange(9))
        rows.append((10 + i, " ".join(w)))
    rows.append((70, rows[-1][1]))
    got = by_id(simhash.near_duplicates(docs(spark, rows), 3, bits, segments))
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    ids = [i for i, _ in rows]
    assert [np.int64(got[i].fp).view(np.uint64) for i in ids] == fps
    roots = brute_components(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= bits)
    assert [got[i].component_id for i in ids] == [min(ids[k] for k in range(len(ids)) if roots[k] == r) for r in roots]
    # with buckets of over four fingerprints dealt out in blocks, and askers two by two
    split = by_id(simhash.near_duplicates(docs(spark, rows), 3, bits, segments, crowd=4, askers=2))
    assert {i: (r.fp, r.component_id) for i, r in split.items()} == {i: (r.fp, r.component_id) for i, r in got.items()}


def test_simhash_cases(spark):
    """Null doc_ids, repeated rows, a very long text, half of the hashes, no rows."""
    long = " ".join(f"w{i % 5003}" for i in range(150_000))
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "A  B c\nd"), (8, "a b c d"), (9, long), (9, long), (None, "all alone here")]
    got = [(r.doc_id, int(np.int64(r.fp).view(np.uint64)), r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()]
    fp = brute_fingerprint("a b c d", 3)  # two shingles: a bit of one of them is exactly half
    assert sorted(map(str, got)) == sorted(map(str, [(i, brute_fingerprint(t, 3), 7 if brute_fingerprint(t, 3) == fp else i) for i, t in rows]))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_links_in_one_large_bucket():
    rng = np.random.default_rng(1)
    centre = np.uint64(rng.integers(1 << 63))
    fp = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(32, 3))) for _ in range(300)], np.uint64))
    rows = np.c_[np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64), fp.astype(np.int64)]
    got = simhash.links(rows, 3)
    assert len(got) < len(fp)
    at = {int(f): i for i, f in enumerate(fp.astype(np.int64))}
    pairs = {tuple(sorted((at[a], at[b]))) for a, b in zip(got["u"], got["v"])}
    want = brute_components(len(fp), lambda i, j: bin(int(fp[i]) ^ int(fp[j])).count("1") <= 3)
    assert brute_components(len(fp), lambda i, j: (j, i) in pairs or (i, j) in pairs) == want


def test_similar_texts(spark):
    """Exact and near copies of similarity 0.8 or more share a component; unrelated texts and those of 0.5 or less stay."""
    rnd = random.Random(11)

    def words(n):
        return ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(n)]

    rows, family = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "three")], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    for g in range(40):
        base = words(400)
        for c in range(4):
            at = 100 + 10 * g + c
            w = list(base)
            for place in rnd.sample(range(0, 400, 10), (0, 3, 6, 8)[c]):  # each word takes five shingles: similarity to the first is 0.82 to 1
                w[place] = "other"
            rows.append((at, " ".join(w)))
            family[at] = 100 + 10 * g
        rows.append((900 + g, " ".join(base[:200] + words(200))))
        family[900 + g] = 900 + g
    rows.append((5000, rows[-2][1]))
    family[5000] = next(family[i] for i, t in rows if t == rows[-1][1])
    got = by_id(similar_texts.near_duplicates(docs(spark, rows)))
    assert {i: got[i].component_id for i in family} == family
    kept = similar_texts.keep_one_row(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(family.values())) and "fp" in kept.columns
    assert similar_texts.keep_one_row(docs(spark, [])).count() == 0
    assert similar_texts.keep_one_row(docs(spark, [(None, "a b c d e f")] * 2)).count() == 1
    # coarse groups of over 32 fingerprints and components of over 900 shingles are dealt out in blocks
    split = by_id(similar_texts.near_duplicates(docs(spark, rows), held=16, shingles=900))
    assert {i: split[i].component_id for i in family} == family


def test_similar_texts_are_verified(spark):
    """Pairs at 0.65 to 0.79 stay whatever their bits; pairs at 0.8 go, also of four and five shingles."""
    rnd, rows, family = random.Random(12), [], {}

    def words(n):
        return ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(n)]

    def jaccard(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return len(x & y) / len(x | y)

    for g in range(60):
        # shingles shared, and alone on each side
        for k, (shared, own, more, links) in enumerate([(4, 0, 1, True), (80, 10, 10, True), (240, 30, 30, True), (5, 1, 1, False), (79, 10, 11, False), (220, 40, 40, False), (235, 30, 35, False), (100, 25, 25, False)]):
            base = words(shared + 4)
            a, b = base + words(own), base + words(more)
            assert (jaccard(a, b) >= 0.8) == links and jaccard(a, b) >= 0.65
            at = 20 * g + 2 * k
            rows += [(at, " ".join(a)), (at + 1, " ".join(b))]
            family[at], family[at + 1] = at, at if links else at + 1
    got = by_id(similar_texts.near_duplicates(docs(spark, rows)))
    wrong = {i for i in family if got[i].component_id != family[i]}
    assert not {i for i in wrong if family[i] == i or i % 20 == 1}  # no false link; short pairs all found
    assert len(wrong) <= 4  # of 120 longer pairs exactly at 0.8 the tables may miss 1 %


def test_one_row_of_each_group_leaves_the_pipeline(spark):
    """Repeated rows, copies without a doc_id and doc_ids of two texts: each text leaves once, whole."""
    import corpus_pipeline

    rnd = random.Random(14)
    a, b, c, d, e, f = (" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(100)) for _ in range(6))
    rows = [(1, a), (1, a), (None, b), (None, b), (3, c), (4, c), (4, d), (6, d), (7, e), (7, e), (None, e), (8, f), (8, f + " more"), (None, None), (9, "")]
    kept = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.drop_near_duplicates(spark, kept, "")
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [(i, t) for i, t in got if i != 8] == sorted([(0, b), (1, a), (3, c), (4, d), (7, e), (9, "")])
    assert [t in (f, f + " more") for i, t in got if i == 8] == [True]
    left = sorted(r.text for r in corpus_pipeline.cut_repeats(spark, kept, "").collect())
    assert left == sorted(t for _, t in got)


def test_similar_sets_against_all_pairs():
    rnd = random.Random(13)
    sets = [np.unique(np.array([rnd.randrange(1 << 60) for _ in range(rnd.choice([1, 5, 60, 300]))], np.uint64)) for _ in range(20)]
    for _ in range(80):
        x = rnd.choice(sets)
        sets.append(np.unique(np.concatenate([x[np.array([rnd.random() < 0.93 for _ in x], bool)], np.array([rnd.randrange(1 << 60)], np.uint64)])))
    fps = np.array([np.frombuffer(similar_texts.set_fingerprint(x), np.uint64) for x in sets])
    want = brute_components(len(sets), lambda i, j: 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j])))
    assert similar_texts.similar(sets, fps, 0.8).tolist() == want


def test_tables_meet_at_the_least_similarity():
    """At any number of fingerprints, pairs exactly at 0.8 meet in some coarse group and in some local table; so do short texts."""
    rng, p = np.random.default_rng(5), similar_texts.apart(0.8)
    for share in (p, similar_texts.SPREAD * p):
        differ = rng.random((2000, 512)) < share
        for rows in (1, 50_000, 10**9):
            met = np.any([~differ[:, own].any(1) for own in similar_texts.coarse(rows)], axis=0)
            assert met.mean() > 0.99
        for width in (8, 14, 20):
            met = np.any([differ[:, own].sum(1) <= 1 for own in similar_texts.segments(width, 1, 0.8, 0.999, 7)], axis=0)
            assert met.mean() > 0.99
    differ = rng.random((2000, 512)) < p
    assert (differ.sum(1) <= similar_texts.candidate_bits()).mean() > 0.998


def family_of_prints(n, spread, rng):
    bits = rng.integers(0, 2, 512, np.uint8)
    return np.array([np.packbits(bits ^ (rng.random(512) < spread)).view(np.uint64) for _ in range(n)])


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(2)
    fps, size = family_of_prints(200, 0.1, rng), np.full(200, 500)
    size[::7] = 300
    u, v = similar_texts.Near(fps, size, 0.8).forest(np.arange(200))
    linked = {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist())}
    bound = similar_texts.candidate_bits()
    want = brute_components(200, lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= bound and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]))
    assert len(u) < 200 and brute_components(200, lambda i, j: (j, i) in linked) == want and len(set(want)) > 1


def test_local_search_against_all_pairs():
    """Families at 0.8 and above, a hot one of near-equal prints, and strangers."""
    rng = np.random.default_rng(3)
    fps = np.concatenate([*(family_of_prints(3, 0.06, rng) for _ in range(150)), family_of_prints(400, 0.005, rng), *(family_of_prints(1, 0, rng) for _ in range(400))])
    size = np.full(len(fps), 200)
    e = similar_texts.near(fps, size)
    got = brute_roots(len(fps), zip(e["u"], e["v"]))
    all_of = similar_texts.Near(fps, size, 0.8)
    want = brute_roots(len(fps), ((i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(all_of.candidates(np.arange(i), i)) if i))
    assert len(e) < len(fps) and got == want


def brute_roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = root(int(i)), root(int(j))
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_blocks_meet_pairwise(spark):
    """Every two rows of a group meet in one block, whether it is split or not; a task never holds more than members and askers."""
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 1), (2, 5), (3, 40)) for i in range(n)], "key long, id long")
    parts = spark.createDataFrame([(3, 4)], "key long, parts long")

    def seen(batches):
        for g in blocks.groups(batches, "key", 6):
            yield pd.DataFrame({"key": g["key"].iloc[0], "ids": [g["id"].tolist()], "size": len(g)})

    for given in (parts, parts.limit(0)):
        got = blocks.dealt(rows, "key", "id", given).mapInPandas(seen, "key long, ids array<long>, size long").collect()
        met = {k: {frozenset((a, b)) for r in got if r.key == k for a in r.ids for b in r.ids if a != b} for k in (1, 2, 3)}
        assert [len(met[k]) for k in (1, 2, 3)] == [0, 10, 780]
        assert {r.key for r in got} == {1, 2, 3}
        if given is parts:
            assert max(r["size"] for r in got) <= 30


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(500, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {frozenset(e) for e in edges}
    want = brute_components(381, lambda i, j: frozenset((i, j)) in linked)
    assert got == {i: r for i, r in enumerate(want) if any(i in e and len(e) == 2 for e in linked)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 240)] + rng.normal(size=(240, 16)) * rng.choice([0.05, 0.2, 1.0], (240, 1)), rng.normal(size=(60, 16))])
    x[50] = x[49]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [], 1), (904, [None] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    got = by_id(embedding_index.near_duplicates(df, k=6, block=16), "vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    found = np.array([got[i].n_links for i in range(300)])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    assert got[50].n_links == got[49].n_links >= 1 and got[50].component_id <= 49
    for i in (*range(900, 907),):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_index.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_small_groups_beside_hot_ones(spark):
    """Three hot groups of near-equal vectors do not set the index for pairs just above the least cosine; links are symmetric."""
    rng = np.random.default_rng(3)

    def directions(n):
        x = rng.normal(size=(n, 64))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    hot = np.repeat(directions(3), 400, axis=0) + rng.normal(size=(1200, 64)) * 1e-4
    one, other = directions(200), directions(200)
    other -= (one * other).sum(1)[:, None] * one
    pairs = 0.953 * one + np.sqrt(1 - 0.953**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    x = np.concatenate([hot, one, pairs, directions(2400)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_id(embedding_index.near_duplicates(df), "vec_id")
    assert all(got[i].n_links == 399 for i in range(1200))
    assert all(got[1200 + i].n_links == got[1400 + i].n_links for i in range(200))
    assert sum(got[i].n_links for i in range(1200, 1600)) >= 0.97 * 400


def test_visits_come_in_order():
    rng = np.random.default_rng(4)
    for k1, k2, cells in ((7, 5, 35), (7, 5, 9), (32, 32, 50), (3, 40, 20), (4, 4, 99)):
        a, b = rng.random((20, k1)), rng.random((20, k2))
        for x, y, got in zip(a, b, embedding_index.visits(a, b, cells)):
            total = (x[:, None] + y).ravel()
            assert got.tolist() == np.argsort(total, kind="stable")[: min(cells, k1 * k2)].tolist()


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def test_exact_embedding_search(spark):
    """Without a calibrated number of visits every link is found, whatever the grid; repeated and null ids, another length, extra columns."""
    rng = np.random.default_rng(6)
    one = rng.normal(size=(150, 24))
    other = one + rng.normal(size=(150, 24)) * rng.choice([0.05, 0.22, 0.3], (150, 1))
    x = np.concatenate([one, other, np.repeat(rng.normal(size=(1, 24)), 40, axis=0) + rng.normal(size=(40, 24)) * 0.02])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(None, x[0].tolist(), 1), (7, x[7].tolist(), 1), (800, [0.5], 1), (801, [0.25], 1), (802, [-0.25], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    near = brute_links(np.concatenate([x, x[[0]], x[[7]]]))
    out = embedding_index.near_duplicates(df, k=9, block=32, exact=True).collect()
    assert len(out) == len(rows)
    got = collections.defaultdict(list)
    for r in out:
        got[r.vec_id].append(r)
    for i in range(len(x)):
        assert {r.n_links for r in got[i]} == {int(near[i].sum())}, i
    assert got[None][0].n_links == near[0].sum() and got[None][0].component_id == got[0][0].component_id
    assert [r.n_links for r in got[800] + got[801] + got[802]] == [1, 1, 0] and got[801][0].component_id == 800
    roots = brute_components(len(near), lambda i, j: near[i, j])
    ids = [*range(len(x)), 0, 7]
    assert [got[i][0].component_id for i in range(len(x))] == [min(ids[k] for k in range(len(ids)) if roots[k] == roots[i]) for i in range(len(x))]


def test_embedding_links_against_their_sql(spark, tmp_path):
    """The query and its SQL on a table that has links: near copies of the driver's vectors, and a hot group."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:120] + rng.normal(size=(120, 16)) * 0.15, np.repeat(base[:1], 60, axis=0) + rng.normal(size=(60, 16)) * 0.01, base[5:9]])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op10_embedding_dedup(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op10_embedding_dedup"]).fetchall())
    assert sum(r[1] for r in want) > 3000
    assert got == want


# --- HTML


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a> <a href=y>More</a></nav>", ""),
        ("<body><header>Site</header><article><h1>Title &amp; more</h1><p>First  para\n graph.<p>Second &lt;b&gt;.</article><footer>f</footer>", "Title & more\nFirst para graph.\nSecond <b>."),
        ("<div class='cookie notice'>We use cookies and more words here</div><main><p>Body text of some length here.</p><form><input>Name</form><div class=comments><p>Nice post!</p></div></main>", "Body text of some length here."),
        ("<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><div id=sidebar><p>About us and our long list of friends</p></div><div><p>One paragraph with words.</p><p>Another paragraph with words.</p></div></body></html>", "One paragraph with words.\nAnother paragraph with words."),
        ("<article><ul><li>one<li>two</ul><!-- no --><table><tr><td>a<td>b</table>tail", "one\ntwo\na\nb\ntail"),
        ("<article><p>cut <b>bold <i>both</b> end<br>line", "cut bold both end line"),
    ],
)
def test_html(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        # no article: densities find the text among unlabelled parts
        ("<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><h1>Head</h1><p>The first paragraph has a good many words in it.<p>And so has the second, which is as long as that.<p>Short.</div><div>(c) us</div></body>", "Head\nThe first paragraph has a good many words in it.\nAnd so has the second, which is as long as that.\nShort."),
        # the article tag wraps an unlabelled menu and a labelled one
        ("<body><article><ul><li><a href=1>Start</a><li><a href=2>News</a><li><a href=3>Sport</a><li><a href=4>More</a></ul><nav><a href=5>x</a></nav><h1>Head</h1><p>The first paragraph has a good many words in it.<p>And so has the second one.</article></body>", "Head\nThe first paragraph has a good many words in it.\nAnd so has the second one."),
        # sections: the densest one is the core, the others reach the threshold
        ("<body><div id=page><section><h2>A</h2><p>Some words that make a paragraph of a text here.<p>Some more words that make another paragraph.</section><section><h2>B</h2><p>Words that make a paragraph in the second section, longer than others here.</section></div></body>", "A\nSome words that make a paragraph of a text here.\nSome more words that make another paragraph.\nB\nWords that make a paragraph in the second section, longer than others here."),
        # a list is the core, its introduction and the end stand beside it
        ("<body><div><h1>List</h1><p>Intro.</p><ul><li>One long item of this list with many words in it<li>Another long item of this list with many words<li>And a third long item of the list, as long</ul><p>End.</p></div></body>", "List\nIntro.\nOne long item of this list with many words in it\nAnother long item of this list with many words\nAnd a third long item of the list, as long\nEnd."),
        # a form around the page, an advert and reader comments inside the article
        ("<body><form><input><main><p>Main text in here, with words and with more words.</p><div class='ad banner'>Buy this now, it is very cheap and good</div><p>Second part of the main text, with words.</p><section id=comments><p>I like this very much, thank you for it.</p></section></main></form></body>", "Main text in here, with words and with more words.\nSecond part of the main text, with words."),
        ("plain text &amp; no markup", "plain text & no markup"),
        ("<p>a &#0065;&#x1F600; &#xD800; &#99999999999999999999;&lt;b&gt;", "a A\U0001F600 \ufffd \ufffd<b>"),
        ("<p title='a > b'>x <a href=\"y>z\">l</a> 1 < 2 <3</p>", "x l 1 < 2 <3"),
    ],
)
def test_html_by_density(page, want):
    assert html_text.extract(page) == want


LONG = "<p>" + "This is a sentence of the article, with a good many words in it. " * 5 + "</p>"
SHORT = " ".join(("This is a sentence of the article, with a good many words in it. " * 5).split())


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><div class="search-results-page">{LONG}{LONG}</div></body>', [SHORT] * 2),
        (f'<div class="post-with-comments">{LONG}{LONG}</div>', [SHORT] * 2),
        (f'<article class="post comments-open">{LONG}{LONG}</article>', [SHORT] * 2),
        (f'<article>{LONG}<div class="notice-board-history">{LONG}</div></article>', [SHORT] * 2),
        (f'<div class="search"><div class="menu">{LONG}{LONG}</div></div>', [SHORT] * 2),
        (f"<div>{LONG}<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b{LONG[3:]}</div>", [SHORT, "a x=2 b" + SHORT]),
        (f'<body><div id="c">{LONG}{LONG}</div><div class="post-comments">{LONG * 5}</div><div class="site-footer"><p>foot</p></div></body>', [SHORT] * 2),
        (f'<body><div class="cookie-banner">{LONG}</div><div>{LONG}{LONG}</div><section id="comments">{LONG}</section></body>', [SHORT] * 2),
        (f'<body><div class="ad">{LONG}</div><div><h1>Short</h1><p>Only this one.</p></div></body>', ["Short", "Only this one."]),
    ],
)
def test_class_names_that_say_more_are_no_cut(page, want):
    assert html_text.extract(page).split("\n") == want


def brute_densities(root):
    """Every node's density and sum from its definition, a walk for each node."""
    def walk(n):
        yield n
        for k in n.kids:
            if not isinstance(k, str):
                yield from walk(k)

    def chars(n, linked=False):
        return sum((len("".join(k.split())) if linked or not within else 0) if isinstance(k, str) else chars(k, linked or k.tag == "a") if within else chars(k) for k in n.kids)

    out = {}
    for n in walk(root):
        within = False
        c, tags = chars(n), max(len(list(walk(n))) - 1, 1)
        within = True
        lc = chars(n, n.tag == "a")
        lt = sum(k.tag == "a" for k in walk(n)) - (n.tag == "a")
        out[n] = c, tags, lc, lt
    whole = out[root]
    density = {}
    for n, (c, t, lc, lt) in out.items():
        base = math.log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e)
        density[n] = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / base if c else 0.0
    return {n: (density[n], sum(density[k] for k in n.kids if not isinstance(k, str) and k.tag in html_text.BLOCK)) for n in out}


def test_densities_by_brute_force():
    rnd = random.Random(31)

    def made(depth):
        kids = [rnd.choice(["words here ", "x", " "]) if depth == 0 or rnd.random() < 0.4 else made(depth - 1) for _ in range(rnd.randrange(0, 5))]
        tag = rnd.choice(["div", "p", "a", "span", "section", "ul", "em"])
        return f"<{tag}>{''.join(kids)}</{tag}>"

    for _ in range(60):
        root = html_text.parse("<body>" + "".join(made(4) for _ in range(4)))
        nodes = html_text.measure(root)
        want = brute_densities(root)
        for n in nodes:
            assert (n.density, n.total) == pytest.approx(want[n]), n.tag


def test_density_decides_on_every_page(spark):
    """The core is no tag's doing: without the tags ``article`` and ``main`` the driver's pages give the same texts."""
    for r in queries.table(spark, "/root/testdata/sf0.001", "pages").select("html").collect():
        bare = re.sub("<(/?)(article|main)\\b", r"<\1div", r.html)
        assert html_text.extract(bare) == html_text.extract(r.html) != ""


@pytest.mark.parametrize("page", ["<a" * 400_000, "<div>" * 100_000 + "</x>" * 100_000, '<a "' * 200_000 + ">", "<a href='" * 100_000 + ">", "&#" + "9" * 900_000, "&#" + "0" * 900_000 + "65;", "<!-" * 300_000, "<script></script" * 60_000, "<ul><li><ul>" + "<div>" * 40_000 + "<li></li>" * 40_000, "<b>" * 90_000 + "<div></div>" * 40_000, "<" * 900_000, "<p class=comments>" * 50_000, "<p " + 'a="b" ' * 150_000 + ">", "<a " + (" " * 1000 + '"') * 900, "<p>text " + "<i>x</i> " * 90_000])
def test_hostile_pages_are_read_in_linear_time(page):
    began = time.perf_counter()
    assert isinstance(html_text.extract(page), str)
    assert time.perf_counter() - began < 5  # one second here, more where other tests run beside it


def test_html_odd_input(spark):
    for page in ("<", "<p", "<!--", "<script>", "<a href='x", "&#x110000; &bogus;", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep", "x" * 100_000):
        assert isinstance(html_text.extract(page), str)
    df = spark.createDataFrame([(1, "u", "<p>Hello there, reader.", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    got = by_id(html_text.extract_pages(df), "page_id")
    assert (got[1].text, got[2].text) == ("Hello there, reader.", "")
    assert [r.text for r in html_text.extract_pages(df.union(df)).orderBy("page_id").collect()] == ["Hello there, reader."] * 2 + ["", ""]
    assert html_text.extract_pages(df.limit(0)).count() == 0


# --- chat

EVENTS = "conv_id long, seq long, kind string, message_id string, role string, text string, turns int, formatted string"


def events(spark, rows):
    return spark.createDataFrame([(*r, 0, "z") for r in rows], EVENTS)


def test_chat_folding(spark):
    rows = [
        (1, 0, "message", "u1", "user", "hi"),
        (1, 1, "message", "a1", "assistant", "he"),
        (1, 2, "delta", "a1", None, "llo"),
        (1, 3, "message", "u2", "user", "dropped by the regeneration"),
        (1, 4, "regenerate", "a1", None, None),
        (1, 5, "delta", "a1", None, "fresh "),
        (1, 6, "delta", None, None, "end"),
        (1, 7, "edit", "u1", None, "hi!"),
        (1, 8, "message", "x", "user", "gone"),
        (1, 9, "delete", "x", None, None),
        (2, 0, None, None, None, None),
    ]
    got = collections.defaultdict(list)
    for r in chat_format.fold_events(events(spark, rows)).orderBy("conv_id", "position").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got[1] == [("user", "hi!"), ("assistant", "fresh end")]
    assert got[2] == [("", "")]


def fold(rows):
    """The events one after another: position, role and text of what is left."""
    lives, opened, every = {}, "none", []
    for at, (_, _, kind, own, role, text) in enumerate(sorted(rows, key=lambda r: (r[1], r[2] or "message", r[3] or "", r[4] or "", r[5] or ""))):
        kind, role, text = kind or "message", role or "", text or ""
        key = f"id:{own}" if own is not None else f"at:{at}" if kind == "message" else opened
        if kind in ("message", "regenerate"):
            opened = key
        now = lives.get(key)
        if now is None or now["deleted"]:
            if now is not None and kind != "message":
                continue
            now = lives[key] = {"at": at, "role": "", "text": "", "deleted": False, "dropped": False}
            every.append(now)
        now["role"] = now["role"] or role
        if kind in ("message", "edit", "regenerate"):
            now["text"] = ""
        if kind == "delete":
            now["deleted"] = True
        else:
            now["text"] += text
        if kind == "regenerate":
            for m in every:
                m["dropped"] |= m["at"] > now["at"]
    return [(m["role"], m["text"]) for m in every if not m["deleted"] and not m["dropped"]]


def test_chat_folding_against_a_sequential_one(spark):
    """Random logs, with deletions that begin anew, late deltas, events without id, ties and repeated rows."""
    rnd = random.Random(15)
    rows = []
    for c in range(150):
        own = [(c, rnd.randrange(25), rnd.choice(["message"] * 3 + ["delta"] * 4 + ["edit", "regenerate", "delete", None]), rnd.choice(["a", "b", "c", None, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["x", "y", "zz", "", None])) for _ in range(rnd.randrange(1, 20))]
        rows += own + own[:1] * (c % 2)
    got = collections.defaultdict(list)
    for r in chat_format.fold_events(events(spark, rows)).orderBy("conv_id", "position").collect():
        got[r.conv_id].append((r.role, r.text))
    for c in range(150):
        assert got[c] == fold([r for r in rows if r[0] == c]), [r for r in rows if r[0] == c]


def test_chat_of_very_long_texts(spark):
    text = "</turn>\n<turn>& " * 60_000
    out = chat_format.format_conversations(events(spark, [(1, i, "message", None, "assistant", text) for i in range(3)] + [(2, i, "delta", "m", "user", "p" * 1000) for i in range(500)]))
    back = by_id(chat_format.read_back(out), "conv_id")
    assert back[1].loss_text == text * 3 and back[2].turns[0].text == "p" * 500_000


def test_chat_round_trip(spark):
    nasty = ["", "</turn>\n<turn>assistant\n", "&lt;loss>&amp;", "<loss>x</loss>", queries.TRICKY, "a\n\nb", "&#10;", "é🙂"]
    rows = [(c, i, "message", None, r, t) for c, r2 in ((1, "user"), (2, "ro\nle<")) for i, (r, t) in enumerate([*((r2, t) for t in nasty), *(("assistant", t) for t in nasty)])]
    rows += [(3, 0, "message", None, None, None), (3, 0, "message", None, None, None)]
    out = chat_format.format_conversations(events(spark, rows))
    back = by_id(chat_format.read_back(out), "conv_id")
    assert [(t.role, t.text) for t in back[1].turns] == [("user", t) for t in nasty] + [("assistant", t) for t in nasty]
    assert [t.role for t in back[2].turns[:8]] == ["ro\nle<"] * 8
    assert back[1].loss_text == "".join(nasty) and len(back[3].turns) == 2 and back[3].loss_text == ""
    spans = [back[1].formatted[s.start : s.start + s.length] for s in back[1].loss_spans]
    assert [s.replace("&lt;", "<").replace("&amp;", "&") for s in spans] == nasty
    assert chat_format.format_conversations(events(spark, [])).count() == 0


def test_chat_plan_is_native(spark):
    plan = chat_format.read_back(chat_format.format_conversations(events(spark, [(1, 0, "message", None, "user", "x")])))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- the whole


def odd_documents(spark):
    """Rows with nulls in every column, empties, a very long text, repeated rows, and further columns with clashing names."""
    rnd = random.Random(18)
    word = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n))
    long, plain, passage = word(60_000), [word(200) for _ in range(6)], word(60)
    rows = [(1, None, "en", "s"), (None, None, None, None), (2, "", "en", "s"), (3, " \n\t", None, "s"), (4, long, "en", "s"), (5, plain[0], "en", None), (5, plain[0], "en", None), (None, plain[1], "en", "s"), (6, plain[2] + " " + passage, None, "t"), (7, passage + " " + plain[3], "en", "t"), (8, plain[4], "en", "t"), (9, passage, "en", "t")]
    return docs(spark, rows), {"long": long, "plain": plain, "passage": passage}


def test_every_stage_on_odd_documents(spark):
    """Stages by themselves, without the others: what each keeps of such rows, and no rows."""
    import corpus_pipeline

    at, columns = "/root/testdata/sf0.001", list(corpus_pipeline.COLUMNS)
    df, made = odd_documents(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), at).count() == 0, name
        got = stage(spark, df, at)
        kept[name] = got.collect()
        if name != "mixture":
            assert got.columns == columns, name
    assert {(r.doc_id, r.text) for r in kept["quality"]} <= {(r.doc_id, r.text) for r in df.collect()}
    near = sorted((r.doc_id or 0, r.text or "") for r in kept["near_duplicates"])
    assert near == sorted([(1, ""), (4, made["long"]), (5, made["plain"][0]), (0, made["plain"][1]), (6, made["plain"][2] + " " + made["passage"]), (7, made["passage"] + " " + made["plain"][3]), (8, made["plain"][4]), (9, made["passage"])])
    cut = {(r.doc_id, (r.text or "").strip(), r.n_chars) for r in kept["repeats"]}
    assert {(4, made["long"]), (8, made["plain"][4]), (6, made["plain"][2]), (7, made["plain"][3])} <= {(i, t) for i, t, _ in cut}
    assert {i for i, _, _ in cut} == {1, None, 2, 3, 4, 6, 7, 8}  # equal rows and the passage alone lose all
    assert len(kept["benchmark_leaks"]) == 12
    assert len(kept["mixture"]) == 12 and sum(r.taken for r in kept["mixture"]) > 0
    again = [sorted(map(str, stage(spark, df.repartition(3), at).collect())) for _, stage in corpus_pipeline.STAGES[1:]]
    assert again == [sorted(map(str, kept[name])) for name, _ in corpus_pipeline.STAGES[1:]]


def brute_near(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := [x.lower() for x in re.findall("[^\x20\x09-\x0d]+", t or "")]) else set() for t in texts]
    return lambda i, j: sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])


def test_pipeline_stages_by_brute_force(spark):
    """On the smallest tables: near duplicates by all pairs, passages of over 50 words by counting them, leaks by every alignment."""
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    raw = queries.table(spark, at, "documents")
    rows = raw.collect()
    roots = brute_components(len(rows), brute_near([r.text for r in rows]))
    kept = corpus_pipeline.drop_near_duplicates(spark, raw, at).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(rows[k].doc_id for k in range(len(rows)) if roots[k] == g) for g in set(roots))
    want = brute_passages([r.text or "" for r in rows], 51)
    left = by_id(corpus_pipeline.cut_repeats(spark, raw, at))
    for r, (w, gone) in zip(rows, want):
        rest = [x for x, g in zip(w, gone) if not g]
        assert (r.doc_id in left) == (not any(gone) or bool(rest))
        if r.doc_id in left:
            assert re.findall("[^\x20\x09-\x0d]+", left[r.doc_id].text or "") == (rest if any(gone) else w)
    items = [decontaminate.tokens(r.text) for r in queries.table(spark, at, "benchmark").collect()]
    clean = {r.doc_id for r in corpus_pipeline.drop_benchmark_leaks(spark, raw, at).collect()}
    for r in rows[:60]:
        words = set(decontaminate.tokens(r.text))
        met = [i for i in items if len(words & set(i)) >= min(12, len(set(i)) * 0.8) and brute_best(r.text, i)]
        assert (r.doc_id in clean) == (not met), r.doc_id


def test_pipeline_and_queries(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    raw = queries.table(spark, at, "documents")
    rows = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows.count(), stage(spark, rows, at)
        assert rows.columns == raw.columns, name
        assert 0 < rows.count() <= before
    mixed = corpus_pipeline.run(spark, at)
    assert mixed.count() == rows.count() and mixed.where("taken > 3 * size").count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, at).schema.names, name
    assert queries.QUERIES["op8_html_extraction"](spark, at).where(F.col("text") == "").count() == 0


# --- fill in the middle


def brute_middle(doc_id, text, seed=7):
    """form, number of lines, prefix, middle and output, with Python's own regular expressions."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return "plain", len(units), None, None, text
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    form = "spm" if h4 % 100 < 50 else "psm"
    return form, len(units), len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def middle_rows():
    rnd = random.Random(13)
    text = lambda: "".join(rnd.choice(["a", "é", "日本", "\n", "\r\n", "<", "P", "S>", "𝄞", "\x00", " ", " "]) for _ in range(rnd.randrange(0, 60)))
    rows = [(i, text()) for i in range(300)]
    return rows + [(300, None), (301, ""), (302, "a<P>b\n"), (303, "<S>"), (304, "x<M>"), (305, "\n"), (None, "a\nb\nc"), (5, rows[5][1]), (5, rows[5][1]), (306, "line\n" * 40_000), (307, "w" * 300_000)]


def test_fill_in_middle(spark):
    rows = middle_rows()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        form, n, p, m, out = brute_middle(i, t)
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    got = fill_middle.digests(docs(spark, rows))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.digests(docs(spark, [])).collect() == []


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_fill_in_middle_round_trip(spark, unit):
    rows = [r for r in middle_rows() if len(r[1] or "") < 1000]
    made = fill_middle.transform(docs(spark, rows), unit=unit, rate=70, spm=20, seed=3, sentinels=("[pre]", "[suf]", "[mid]"))
    back = fill_middle.restore(made, ("[pre]", "[suf]", "[mid]"))
    assert sorted(map(repr, [(i, t or "") for i, t in rows])) == sorted(repr(tuple(r)) for r in back.collect())
    forms = collections.Counter(r.form for r in made.collect())
    assert len(forms) == 3 and forms["psm"] > forms["spm"]


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "ba", "c"), ("x", "axb", "c")])
def test_fill_in_middle_refuses_ambiguous_sentinels(spark, bad):
    with pytest.raises(ValueError):
        fill_middle.transform(docs(spark, []), sentinels=bad)


def test_fill_in_middle_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r for r in middle_rows() if r[0] is not None and "\x00" not in (r[1] or "")], columns=["doc_id", "text"]))
    rows = con.execute(queries.ORACLE_SQL["op13_fill_in_middle"]).fetchall()
    want = {i: brute_middle(i, t) for i, t in middle_rows()}
    assert len(rows) > 50 and all((r[2], r[1], r[3], r[4], r[5]) == (*want[r[0]][:4], hashlib.sha256(want[r[0]][4].encode()).hexdigest()) for r in rows)


# --- best-fit packing


@pytest.fixture(scope="module")
def whole_tokens():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def odd_text(rnd, n):
    """Letters, marks that compose, case that changes length, all kinds of white space, runs of punctuation, strings like special tokens."""
    parts = ["a", "B", "é", "É", "İ", "ß", "\u212a", "Σ", "ς", " ", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u200b", ".", ",", "...", "'s", "'T", "'ll", "?!", "1", "23", "日本", "𝄞", "\u0301", "\u0338"]
    parts += ["<|endoftext|>", "</w>", "<", "=", "x.", "x,", "ﬁ", "Ⅷ", "\x00", "が", "가", "don't", "\""]
    return "".join(rnd.choice(parts) for _ in range(n))


def test_tokens_word_by_word_equal_whole_texts(whole_tokens):
    import pyarrow as pa

    rnd = random.Random(12)
    words = packing.Words(open(queries.tokenizer_path(), encoding="utf-8").read())
    for _ in range(3):
        texts = [odd_text(rnd, rnd.randrange(0, 40)) for _ in range(4000)] + [None, ""]
        flat, cuts = words.ids(pa.array(texts).slice(1))
        assert [flat[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [whole_tokens(t)[:-1] for t in texts[1:]]


def test_best_fit():
    rnd = random.Random(4)
    for capacity in (1, 7, 100):
        sizes = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(0, 400))]
        first, offset, held = packing.best_fit(sizes, capacity)
        bins: list[list[int]] = []  # the plain way: all bins, the fullest that fits
        for i, s in enumerate(sizes):
            fits = [b for b in bins if b[1] + s <= capacity]
            if fits:
                b = max(fits, key=lambda b: b[1])
                b[1] += s
            else:
                bins.append([i, s])
        assert sorted(held[i] for i, f in enumerate(first) if f == i) == sorted(b[1] for b in bins)
        spans = collections.defaultdict(list)
        for f, o, s in zip(first, offset, sizes):
            spans[f].append((o, s))
        for f, got in spans.items():
            got.sort()
            assert [o for o, _ in got] == [sum(s for _, s in got[:k]) for k in range(len(got))] and held[f] == sum(s for _, s in got) <= capacity


@pytest.mark.parametrize("bucket", [10, 16_384])
def test_packing(spark, whole_tokens, bucket):
    import zlib

    rnd = random.Random(8)
    rows = [(i, odd_text(rnd, int(rnd.expovariate(1 / 60)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, "word " * 700), (303, " \n"), (None, "no id"), (None, "no id"), (5, rows[5][1]), (5, rows[5][1]), (306, "x" * 3000), *[(400, "a b c d e")] * 60]
    capacity = 128
    whole = packing.pack(docs(spark, rows), queries.tokenizer_path(), capacity=capacity, bucket=bucket, ids=True)
    got = whole.drop("ids").collect()
    want = []
    for i, t in rows:
        ids = whole_tokens(t)
        want += [(i, k, lo, len(ids[lo : lo + capacity]), zlib.crc32(np.array(ids[lo : lo + capacity], "<u4").tobytes())) for k, lo in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, want)) == sorted(str(tuple(r[:5])) for r in got)
    spans = collections.defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for span in spans.values():
        span.sort()
        assert [o for o, _ in span] == [sum(n for _, n in span[:k]) for k in range(len(span))] and sum(n for _, n in span) <= capacity
    least = -(-sum(w[3] for w in want) // capacity)
    assert len(spans) <= least + 1 + (bucket == 10) * 0.1 * least
    # the sequences themselves
    made = packing.sequences(whole).collect()
    assert sum(r.length for r in made) == sum(w[3] for w in want) and all(len(r.ids) == 4 * r.length for r in made)
    assert sum(np.frombuffer(r.ids, "<u4").sum() for r in made) == sum(sum(whole_tokens(t)) for _, t in rows)
    assert packing.pack(docs(spark, []), queries.tokenizer_path()).collect() == []


def test_packing_of_pieces_that_cannot_share(spark):
    """Bins that never fill: rounds end, and nothing is lost."""
    rows = [(i, "word " * 70) for i in range(90)] + [(200, "word")]
    got = packing.pack(docs(spark, rows), queries.tokenizer_path(), capacity=128, bucket=8).collect()
    assert len(got) == 91 and len({r.sequence_id for r in got}) == 90


# --- spelling variants


def one_edit(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in alphabet}
    return (out | {word[:i] + x + word[i:] for i in range(len(word) + 1) for x in alphabet}) - {word}


def made_words(seed, letters, n):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(7, 11))) for _ in range(n)})


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh"])
def test_automaton(letters):
    words = made_words(1, letters, 1500)
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("zz") == a.number(words[0][:-1] + "zz") == -1
    # minimal: no two states lead to the same endings
    endings = {}
    for state in sorted(range(len(a.edges)), key=lambda s: a.words[s]):
        endings.setdefault((a.final[state], *sorted(a.edges[state].items())), []).append(state)
    live, todo = set(), [0]
    while todo:
        if (s := todo.pop()) not in live:
            live.add(s)
            todo += a.edges[s].values()
    assert all(len([s for s in same if s in live]) < 2 for same in endings.values())
    known = set(words)
    for w in words[:200]:
        for exact in (0, 3, len(w)):
            assert {words[i] for i in a.near(w, exact)} == {v for v in one_edit(w, letters) & known if len(v) >= len(w) and v[:exact] == w[:exact]}
    assert spelling.Automaton([]).near("abc", 0) == set()


@pytest.mark.parametrize("crowd", [20_000, 40, 5])
def test_near_words(spark, crowd):
    """Also where groups are split down to one letter."""
    words, rnd = made_words(2, "abé", 2500), random.Random(2)
    words += ["a" * 30 + x for x in ("", "b", "c", "bb")]
    n = {w: rnd.randrange(1, 40) for w in words}
    got = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), crowd).collect()}
    want = {}
    for w in n:
        if near := one_edit(w, "abéc") & set(n):
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = len(near), best, n[best]
    assert got == want and len(got) > 1000


def brute_variants(rows, every=31, times=10):
    import zlib

    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    alphabet, out = {x for w in n for x in w}, {}
    for w, k in n.items():
        near = one_edit(w, alphabet) & set(n)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best, n[best], len(near)) if best and n[best] >= times * k else (None, None, len(near))
    rows = []
    for w, (form, form_n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], near, form_n))
    return rows


def spelling_rows():
    rnd = random.Random(6)
    common = ["Étoilesque", "bananas", "Strawberry", "ÀÉÎõüÿþß", "strawbery", "queueing", "x×y÷zabc", "short"]
    rows = [(i, "".join(rnd.choice(common) + rnd.choice([" ", "1", ", ", "\u0301", "日", "Ā", "\n"]) for _ in range(rnd.randrange(0, 80)))) for i in range(150)]
    # a chain: some 3, 40 and 600 occurrences, one edit apart each, and a tie for the form
    chain = [(500 + i, " ".join(["abcdefghi"] * 30 + ["abcdefgxi"] * 2 + ["abcdefgxyi"] * (i % 7 == 0))) for i in range(20)]
    return rows + chain + [(900, None), (901, ""), (902, "no words 1234567"), (None, "bananas bananas"), (5, rows[5][1]), (5, rows[5][1]), (903, "tiedfora tiedfora tiedforb tiedforb"), (904, "tiedforc " * 30 + "tiedford " * 30)]


def test_spelling_variants(spark):
    rows = spelling_rows()
    got = spelling.variants(docs(spark, rows), every=31)
    want = brute_variants(rows)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[3] > 200 for w in want)
    assert spelling.variants(docs(spark, [])).collect() == []
    whole = spelling.words_of(docs(spark, [(1, "ABCDEFGabcdefg" * 20_000)]), None)
    assert [(len(r.word), r.n) for r in whole.collect()] == [(280_000, 1)]


def test_spelling_variants_sql():
    import duckdb

    rows = [r for r in spelling_rows() if r[0] is not None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(map(repr, con.execute(queries.ORACLE_SQL["op11_spelling_variants"]).fetchall())) == sorted(map(repr, brute_variants(rows)))


def test_repeated_tokens_are_not_multiplied(spark):
    """A text and an item of one token over and over: a few seed rows each, one overlap. And more items in a text than one row holds."""
    at, h = np.arange(10, 2000), np.full(1990, 5, np.uint64)
    assert [x.tolist() for x in decontaminate.runs(np.concatenate([[3], at, [2000, 3000]]), np.concatenate([[5], h, [7, 6]]).astype(np.uint64))] == [[5, 5, 7, 6], [3, 10, 2000, 3000], [3, 1999, 2000, 3000]]
    assert [len(x) for x in decontaminate.runs(at[:0], h[:0])] == [0, 0, 0]
    items = [(1, "spam " * 500), (2, "the quick brown fox jumps over the lazy dog and runs far away from here now")]
    texts = [(1, "spam " * 2000), (2, "ham " * 50 + "spam " * 30), (3, "ham " * 100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.length, r.matched) for r in decontaminate.overlaps(docs(spark, texts), bench).collect()}
    assert got == {(1, 1): (0, 500, 500), (2, 1): (50, 30, 30)}
    words = [f"w{i}" for i in range(40)]
    rnd = random.Random(3)
    many = [(i, " ".join(rnd.choice(words) for _ in range(16))) for i in range(600)]
    got = decontaminate.overlaps(docs(spark, [(1, " . ".join(t for _, t in many))]), spark.createDataFrame(many, "item_id long, text string"))
    assert sorted(r.item_id for r in got.collect()) == list(range(600))


def test_user_columns_named_like_internal_ones(spark):
    """Every operator that passes columns through keeps those whose names it uses itself."""
    names = ["_h1", "_h2", "_H", "_word", "_mask", "_runs", "_rest", "_stays", "_found", "__h1"]
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "alone in the world of many words"), (2, passage + " one"), (3, passage + " two and more"), (4, "alone in the world of many words"), (5, "the quick brown fox jumps over the lazy dog and runs far away")]
    df = docs(spark, rows).select("doc_id", "text", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    profiles = language_id.learn(spark.createDataFrame([("some english text", "en"), ("du texte en langue", "fr")], "text string, lang string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    for got, ids in (
        (decontaminate.clean(df, bench), {1, 2, 3, 4}),
        (suffix_dedup.remove(df, suffix_dedup.WORDS), {1, 2, 3, 4, 5}),
        (similar_texts.keep_one_row(df), {1, 2, 5}),
        (language_id.predict(df, profiles).drop("lang_pred", "score"), {1, 2, 3, 4, 5}),
        (toxicity.score(df, toxicity.train(df, labels)).drop("expected_severity", "p_toxic", "severity"), {1, 2, 3, 4, 5}),
    ):
        assert got.columns == df.columns
        rows_ = got.collect()
        assert {r.doc_id for r in rows_} == ids and all(r[n] == f"{n}{r.doc_id}" for r in rows_ for n in names)


def test_op1_tells_passages_shorter_than_its_bytes(spark, tmp_path):
    """A passage of 51 short words that two documents share is under 400 bytes: no byte goes, and the query says which documents hold it."""
    rnd = random.Random(23)
    word = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(n))
    shared = word(51)
    rows = [(1, f"{word(80)} {shared} {word(20)}"), (2, f"{word(5)}\n{shared}"), (3, word(150)), (4, f"{word(30)} {shared.rpartition(' ')[0]} {word(9)}"), (5, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op1_suffix_dedup(spark, str(tmp_path)))
    assert len(shared) < 400 and {i: (r.n_removed, r.n_passage_words) for i, r in got.items()} == {1: (0, 51), 2: (0, 51), 3: (0, 0), 4: (0, 0), 5: (0, 0)}

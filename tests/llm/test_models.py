"""Classifiers by held-out accuracy, decontamination by brute force, URL rules, and the pipeline."""

import dataclasses
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontamination as dc
from textloom.llm import language_id, quality, toxicity, url_filter
from textloom.llm.batches import fold

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
ODD = [(1, None), (None, "the of and"), (4, ""), (4, ""), (6, "\n\n"), (7, "123 !!"), (8, "word " * 30000)]


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet").cache() for n in ("documents", "labels", "benchmark", "pages")}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "en", "s", 0.0) for k, t in ODD], "doc_id long, text string, lang string, source string, score double")


@needs_tables
def test_quality(tables, odd):
    docs, labels = tables["documents"], tables["labels"]
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) >= 0.98
    got = quality.quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({round(r.score, 9) for r in quality.quality(docs, labels.limit(0)).collect()}) == 1
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns


def test_forward_backward_equals_enumeration(monkeypatch):
    """Marginals of short chains against the sum over all labellings."""
    rng = np.random.default_rng(0)
    chains = [rng.normal(size=(n, 3)) for n in (4, 1, 3, 4, 2)]
    field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    for cells in (200_000, 5):
        monkeypatch.setattr(quality, "CELLS", cells)
        for chain, got in zip(chains, field.marginals([c @ field.weights for c in chains]), strict=True):
            n, u = len(chain), chain @ field.weights
            weights = {}
            for code in range(2**n):
                y = [code >> k & 1 for k in range(n)]
                weights[tuple(y)] = np.exp(sum(u[k] * y[k] for k in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total = sum(weights.values())
            assert got == pytest.approx([sum(w for y, w in weights.items() if y[k]) / total for k in range(n)])


def slow_quality(field, text):
    """Length-weighted P(good) by a plain forward-backward over the whole text."""
    lines = quality.Lines(text)
    u = lines.features(0, len(lines.lines)) @ field.weights
    unary, move = np.column_stack([np.ones(len(u)), np.exp(u)]), np.exp(field.moves)
    ahead = [unary[0] / unary[0].sum()]
    for row in unary[1:]:
        ahead.append((ahead[-1] @ move) * row)
        ahead[-1] /= ahead[-1].sum()
    behind = [np.ones(2)]
    for row in unary[:0:-1]:
        behind.append(move @ (row * behind[-1]))
        behind[-1] /= behind[-1].sum()
    both = np.array(ahead) * np.array(behind[::-1])
    raw = np.clip(np.average(both[:, 1] / both.sum(axis=1), weights=lines.sizes if lines.sizes.any() else None), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(field.slope * np.log(raw / (1 - raw)) + field.shift)))


def test_quality_scores_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join("### $$$ @@@ %%" if rng.random() < (0.7 if k % 2 else 0.1) else "some words of a line, and more." for _ in range(rng.randint(1, 9))), k % 2) for k in range(60)]
    docs = spark.createDataFrame([(k, t, "s", 0.1) for k, t, _ in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, 1 - bad) for k, _, bad in rows], "doc_id long, quality int")
    field = quality.fit(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2).withColumnRenamed("quality", "label"))
    text = {k: t for k, t, _ in rows}
    for r in quality.quality(docs, labels).collect():
        assert r.score == pytest.approx(slow_quality(field, text[r.doc_id]), abs=1e-6)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {k for k, t in text.items() if slow_quality(field, t) >= 0.7}


def test_many_lines_need_little_memory(monkeypatch):
    """A text of 200,000 lines beside short ones: pieces give what the whole gives, and padding stays bounded."""
    import tracemalloc

    long = "ab\ncd\n" * 100_000
    rng = np.random.default_rng(1)
    field = quality.Field(rng.normal(size=quality.Lines("").features(0, 1).shape[1]), rng.normal(size=(2, 2)))
    tracemalloc.start()
    got = field.raw([long] + ["x y"] * 255)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    text = "a b c\n\nA B\na b c\n###"
    whole = quality.Lines(text).features(0, 5)
    monkeypatch.setattr(quality, "LINES", 2)
    assert quality.Lines(text).pulls(field.weights) == pytest.approx(whole @ field.weights)
    assert np.isfinite(got).all() and len(got) == 256


@needs_tables
def test_toxicity(spark, tables, odd):
    docs, labels = tables["documents"], tables["labels"]
    words = r"(?i)\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|scum|loser|moron)\b"
    got = toxicity.toxicity(docs, labels).join(docs.select("doc_id", F.col("text").rlike(words).alias("insults")), "doc_id").join(labels, "doc_id", "left").collect()
    assert np.mean([r.predicted for r in got if r.insults]) >= 0.8
    assert np.mean([r.predicted for r in got if r.toxic == 0]) <= 0.03
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()}) == 1


def slow_toxic_ratios(rows, text):
    """Toxic less ordinary log-likelihood of each different bigram of a text, from plain counts."""
    from collections import Counter

    def pairs(t):
        w = [None, *re.findall(r"[^\W_]+", (t or "").lower())]
        return set(zip(w, w[1:], strict=False))

    seen = {c: Counter(p for t, label in rows if label == c for p in pairs(t)) for c in (0, 1)}
    either = set(seen[0]) | set(seen[1])
    spread = Counter(w for _, w in either)

    def discount(counts):
        one, two = (sum(n == k for n in counts.values()) for k in (1, 2))
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    def part(counts, key, d):
        n = counts.get(key, 0)
        return n - d if n > toxicity.RARE else 0.0

    def chance(c, left, word):
        after = Counter(w for _, w in seen[c])
        d1, d2, total = discount(after), discount(seen[c]), sum(after.values())
        rest = sum(n if n <= toxicity.RARE else d1 for n in after.values()) / total
        lower = part(after, word, d1) / total + rest * (spread[word] + 0.5) / (len(either) + 0.5 * (len(spread) + 1))
        own = {w: n for (h, w), n in seen[c].items() if h == left}
        if not own:
            return lower
        held = sum(n if n <= toxicity.RARE else d2 for n in own.values()) / sum(own.values())
        return part(own, word, d2) / sum(own.values()) + held * lower

    return sorted(np.log(chance(1, *p)) - np.log(chance(0, *p)) for p in pairs(text))


def test_toxic_scores_equal_brute_force(spark):
    """Ratios and whole scores of the query against counts made in plain Python; the tables, too, are distributions."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(["a", "b", "c", "d"] + ["x", "y"] * (k % 3 == 0), k=rng.randint(0, 14))), int(k % 3 == 0)) for k in range(60)]
    model = toxicity.train(toxicity.count_pairs(spark.createDataFrame([r[1:] for r in rows], "text string, label int")))
    texts = ["a b x y q", "x x a", "d c b a b", "q r"]
    for text in texts:
        left, word, keys = toxicity.bigrams(toxicity.word_numbers(text))
        counts = toxicity.count_pairs(spark.createDataFrame([r[1:] for r in rows], "text string, label int"))
        got = model.ratios(left, word, toxicity.counts_of(counts, keys)[keys])
        assert sorted(got) == pytest.approx(slow_toxic_ratios([r[1:] for r in rows], text))
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    known = docs.select("doc_id", F.col("text")).where("doc_id < 60").select("doc_id")
    labels = known.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    learned = [r[1:] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    beta = toxicity.fit(docs.where(fold("doc_id", 3) != 1), labels.where(fold("doc_id", 3) != 1).withColumnRenamed("toxic", "label"))[0].beta
    for r in toxicity.toxicity(docs, labels).collect():
        text = dict([(x[0], x[1]) for x in rows] + [(100 + k, t) for k, t in enumerate(texts)])[r.doc_id]
        x = toxicity.measures(np.array(slow_toxic_ratios(learned, text)))
        assert r.score == pytest.approx(1 / (1 + np.exp(-x @ beta)), abs=1e-5)


def test_toxic_counts_follow_the_texts(spark):
    """The tables equal counts made in plain Python."""
    rows = [("a b a b c", 0), ("b c", 1), ("", 0), (None, 1), ("A b!", 1)]
    model = toxicity.train(toxicity.count_pairs(spark.createDataFrame(rows, "text string, label int")))
    number = {w: int(toxicity.word_numbers(w)[0]) for w in "abc"}
    assert model.words[number["b"]].tolist() == [1, 2] and model.words[number["a"]].tolist() == [2, 1]
    assert model.contexts[0].tolist() == [1, 2] and model.contexts[number["b"]].tolist() == [2, 1]
    spread = {w: model.shared[number[w]] for w in "abc"}
    assert spread["a"] == spread["b"] > spread["c"] > model.shared[toxicity.word_numbers("zzz")[0]]


def test_toxic_words_and_bigrams_stay_apart(spark):
    """Words that share 20 bits of crc32, or bigrams that shared one of 2^22 buckets, have counts of their own."""
    rng, seen, twins = random.Random(6), {}, []
    for word in {"".join(rng.choices("abcdefghij", k=9)) for _ in range(20000)}:
        other = seen.setdefault(zlib.crc32(word.encode()) & 0xFFFFF, word)
        twins += [(other, word)] if other != word else []
    assert len(twins) > 100
    for a, b in twins[:20]:
        assert toxicity.word_numbers(a)[0] != toxicity.word_numbers(b)[0]
    (a, b), *_ = twins
    rows = [(f"{x} {a}", 0) for x in "klmno"] + [(f"{x} {b}", 1) for x in "klmnopq"] + [(a, 0)] * 5 + [(b, 1)] * 7
    pairs = toxicity.count_pairs(spark.createDataFrame(rows, "text string, label int"))
    model = toxicity.train(pairs)
    assert model.words[toxicity.word_numbers(a)[0]].tolist() == [6, 0] and model.words[toxicity.word_numbers(b)[0]].tolist() == [0, 8]
    assert sorted((r.ordinary, r.toxic) for r in toxicity.often(pairs).collect()) == [(0, 7), (5, 0)]
    many = spark.createDataFrame([(" ".join(f"v{k}" for k in range(60000)), 0)], "text string, label int")
    assert len(toxicity.train(toxicity.count_pairs(many)).words.keys) == toxicity.count_pairs(many).count() == 60000


@needs_tables
def test_toxic_rounds_and_left_out_words_change_no_score(spark, tables, monkeypatch):
    docs, labels = tables["documents"], tables["labels"]
    whole = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "PAIRS_AT_ONCE", 600)
    parts = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(parts) == len(whole) and max(abs(parts[k] - whole[k]) for k in whole) < 1e-6
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda pairs, least=0: train(pairs))
    full = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert max(abs(full[k] - whole[k]) for k in whole) < 1e-5


@needs_tables
def test_language(tables, odd):
    docs = tables["documents"]
    rows = language_id.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
    got = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert got[1].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" and got[None].lang_pred == got[8].lang_pred == "en"
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()} == {"und"}


def slow_entropies(texts, text):
    """Cross-entropy of a text in each language, from plain counts of character trigrams."""
    from collections import Counter

    def grams(t):
        s = [" ", " "]
        for c in t + " ":
            c = c.lower()[0] if c.isalpha() else " "
            if c != " " or s[-1] != " ":
                s.append(c)
        return list(zip(s, s[1:], s[2:], strict=False)) if len(s) > 3 else []

    counted = {lang: Counter(g for t in held for g in grams(t)) for lang, held in texts.items()}
    alphabet = len({g[2] for c in counted.values() for g in c}) + 1

    def discount(counts):
        one, two = (sum(n == k for n in counts.values()) for k in (1, 2))
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    out = {}
    for lang, c3 in counted.items():
        c2 = Counter(g[1:] for g in c3)
        c1 = Counter(g[1] for g in c2)
        d1, d2, d3 = discount(c1), discount(c2), discount(c3)

        def p1(w, c1=c1, d1=d1):
            total = sum(c1.values())
            return max(c1[w] - d1, 0) / total + d1 * len(c1) / total / alphabet

        def p2(v, w, c2=c2, d2=d2, p1=p1):
            own = {g[1]: n for g, n in c2.items() if g[0] == v}
            total = sum(own.values())
            return max(own.get(w, 0) - d2, 0) / total + d2 * len(own) / total * p1(w) if own else p1(w)

        def p3(u, v, w, c3=c3, d3=d3, p2=p2):
            own = {g[2]: n for g, n in c3.items() if g[:2] == (u, v)}
            total = sum(own.values())
            return max(own.get(w, 0) - d3, 0) / total + d3 * len(own) / total * p2(v, w) if own else p2(v, w)

        found = grams(text)
        out[lang] = -sum(np.log(p3(*g)) for g in found) / len(found)
    return out


LINES = {"el": ["το βουνό είναι ψηλό", "η θάλασσα είναι βαθιά"], "en": ["the hill is high", "The sea is deep and 3 wide"], "ru": ["гора очень высокая", "море глубокое и синее"], "zh": ["山 很高 海 很深 𠀀𠀁", "山高海深"]}


@pytest.mark.parametrize("at_once", [6_000_000, 1])
def test_languages_equal_brute_force(spark, monkeypatch, at_once):
    """Languages, scores and entropies of the query, in one round or one for each language, against plain counts."""
    monkeypatch.setattr(language_id, "KEYS_AT_ONCE", at_once)
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, held in LINES.items() for t in held)]
    learned = {lang: [t for k, t, x in rows if x == lang and zlib.crc32(str(k).encode()) % 4 != 2] for lang in LINES}
    docs = spark.createDataFrame([*rows, (100, "the sea", None), (101, "海", None), (102, "θάλασσα", None), (103, "???", None), (104, "море", None)], "doc_id long, text string, lang string")
    trained = language_id.Trained(docs.where(F.coalesce(fold("doc_id", 4) != 2, F.lit(True))))
    assert len(trained.groups) == (1 if at_once > 1 else len([x for x in learned.values() if x]))
    t = trained.calibration.temperature
    for r in language_id.identify(docs).collect():
        text = next(d.text for d in docs.collect() if d.doc_id == r.doc_id)
        if text == "???":
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        h = slow_entropies({k: v for k, v in learned.items() if v}, text)
        size = language_id.trigrams(text)[1].sum()
        assert r.lang_pred == min(h, key=h.get), text
        odds = sum(np.exp(-(x - min(h.values())) * t * np.sqrt(size)) for x in h.values())
        assert r.score == pytest.approx(1 / odds, rel=1e-4)


@pytest.mark.parametrize("at_once", [6_000_000, 1])
def test_every_training_text_calibrates(spark, monkeypatch, at_once):
    """Temperature and thresholds against plain loops over all texts: however many, however long, with or without an id."""
    monkeypatch.setattr(language_id, "KEYS_AT_ONCE", at_once)
    rng = random.Random(6)
    words = {"en": "the hill is high and sea deep old so near".split(), "no": "det er en hav og fjell som de ligger so near".split()}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(1, 6))), lang) for k, lang in enumerate(["en"] * 1300 + ["no"] * 150)]
    odd = ["".join(rng.choices("qxzkwvj ", k=30_000)) for _ in range(20)]
    rows += [(None, t, "en") for t in odd] + [(5, rows[5][1], "en"), (7000, None, "en"), (7001, "??", "no"), (7002, "the", None)]
    trained = language_id.Trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(trained.groups) == (1 if at_once > 1 else 2)
    texts = [(lang, language_id.trigrams(t)) for _, t, lang in rows if t and lang and t != "??"]
    counts = {lang: language_id._summed(np.concatenate([np.repeat(*g) for x, g in texts if x == lang])) for lang in words}
    alphabet = len({int(k) & language_id.SYMBOL for keys, _ in counts.values() for k in keys}) + 1
    models = {lang: language_id.Model.of(*c, alphabet) for lang, c in counts.items()}
    h, losses = {"en": [], "no": []}, np.zeros(41)
    for own, (keys, n) in texts:
        all_, here = dict(zip(*counts[own], strict=True)), []
        for lang, m in models.items():
            # A trigram of no other text: one that the model can't find.
            logs = m.logs(keys)
            if lang == own and (alone := np.array([all_[k] == c for k, c in zip(keys, n, strict=True)])).any():
                left = ~np.isin(m.keys3, keys[alone])
                without = dataclasses.replace(m, keys3=m.keys3[left], log3=m.log3[left], counts3=m.counts3[left])
                logs = np.where(alone, without.logs(keys), logs)
            here.append(-(n @ logs) / n.sum())
        y = list(models).index(own)
        h[own].append(here[y])
        losses += [(here[y] - min(here)) * np.sqrt(n.sum()) * t + np.log(np.exp(-(np.array(here) - min(here)) * np.sqrt(n.sum()) * t).sum()) for t in np.geomspace(0.1, 10, 41)]
    assert trained.calibration.temperature == pytest.approx(np.geomspace(0.1, 10, 41)[losses.argmin()])
    for lang, own in h.items():
        last = sorted(own)[int(np.ceil(0.995 * len(own))) - 1]
        assert last + 0.5 - 1e-9 <= trained.calibration.reject[lang] <= last + 0.501 + 1e-9
    # The long texts without an id hold the last place that counts.
    assert trained.calibration.reject["en"] > max(x for x in sorted(h["en"])[: -len(odd)]) + 0.5


def test_character_models_are_distributions():
    """Each context's probabilities add up to one over all symbols known and one for the rest, seen or not."""
    texts = {"x": ["abc abd", "aab"], "y": ["zzz b", "日本 語"]}
    counts = {lang: language_id._summed(np.concatenate([np.repeat(*language_id.trigrams(t)) for t in held])) for lang, held in texts.items()}
    letters = sorted({int(k) & language_id.SYMBOL for keys, _ in counts.values() for k in keys}) + [0x0416]
    models = [language_id.Model.of(*c, len(letters)) for c in counts.values()]
    for a, b in (("a", "b"), (None, "a"), ("q", "q"), ("日", "本")):
        context = [ord(c) if c else 0 for c in (a, b)]
        keys = np.array([context[0] << 42 | context[1] << 21 | s for s in letters])
        for m in models:
            assert np.exp(m.logs(keys)).sum() == pytest.approx(1.0, abs=1e-5)


@needs_tables
def test_decontamination_equals_brute_force(tables):
    docs, items = tables["documents"], tables["benchmark"]
    wanted = set()
    shingles = {r.item_id: dc.shingles(dc.words(r.text)) for r in items.collect()}
    for d in docs.collect():
        own = dc.shingles(dc.words(d.text))
        wanted |= {(d.doc_id, i) for i, s in shingles.items() if len(s & own) >= 0.8 * len(s)}
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()}
    assert got == wanted
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in wanted})


def test_block_max_search_equals_scoring_all():
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randint(3, 15)))) for k in range(50)]
    df = dc.Counter(t for _, text in items for t in set(dc.words(text)))
    index = dc.ItemIndex(items, df, 50, sum(len(dc.words(t)) for _, t in items) / 50)
    for _ in range(60):
        tokens = rng.choices(vocabulary, k=rng.randint(1, 70))
        ids = np.array([index.term.get(t, -1) for t in tokens])
        step = max(index.longest, 8)
        for threshold in (0.2, 0.5):
            found = set()
            for window, block, terms in index.candidates(ids, step, threshold):
                found |= {(window, at) for at, _ in index._walk([index.postings[t] for t in terms], block * dc.BLOCK, (block + 1) * dc.BLOCK, threshold - 1e-9)}
            want = set()
            for window in range(max(1, -(-(len(ids) - step) // step))):
                held = set(ids[window * step : (window + 2) * step].tolist()) - {-1}
                for at in range(len(index.items)):
                    if sum(index.postings[t].get(at, 0.0) for t in held) >= threshold - 1e-9:
                        want.add((window, at))
            assert found == want


@pytest.mark.parametrize("chars", [dc.INDEX_CHARS, 200])
def test_questions_and_answers_equal_brute_force(spark, chars):
    """Pairs by the whole rule, scored exhaustively from plain counts: passages, threshold, and question and answer alike."""
    import math

    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(80)]
    items = [(k, f"{' '.join(rng.choices(vocabulary, k=rng.randint(6, 12)))}? {' '.join(rng.choices(vocabulary, k=rng.randint(2, 9)))}") for k in range(12)]
    docs = []
    for k in range(150):
        question, answer = items[k % 12][1].split("? ")
        parts = [question if rng.random() < 0.7 else "", " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30]))), answer if rng.random() < 0.7 else "", " ".join(rng.choices(vocabulary, k=20))]
        rng.shuffle(parts)
        docs.append((k, " ".join(parts)))
    counted = [(i, dc.Counter(dc.words(t)), dc.shingles(dc.words(t)), *(dc.shingles(dc.words(p)) for p in t.split("? "))) for i, t in items]
    df = dc.Counter(w for _, c, *_ in counted for w in c)
    mean = sum(sum(c.values()) for _, c, *_ in counted) / 12
    want = set()
    for doc, text in docs:
        tokens = dc.words(text)
        for item, tf, whole, question, answer in counted:
            norm = 1.2 * (0.25 + 0.75 * sum(tf.values()) / mean)
            weight = {w: math.log(1 + (12 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + norm) for w, n in tf.items()}
            step = max(8, *(sum(c.values()) for _, c, *_ in counted))
            for at in range(0, max(1, len(tokens) - step), step):
                passage = tokens[at : at + 2 * step]
                if sum(v for w, v in weight.items() if w in passage) / sum(weight.values()) < 0.5 - 1e-9:
                    continue
                near, joined = dc.shingles(passage), f" {' '.join(passage)} "
                shares = [sum(s in near if len(s) == 5 else f" {' '.join(s)} " in joined for s in part) / len(part) for part in (whole, question, answer)]
                if shares[0] >= 0.8 or min(shares[1:]) >= 0.8:
                    want.add((doc, item))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    if chars > 200:
        assert {(r.doc_id, r.item_id) for r in dc.contaminated(frame, bench).collect()} == want
        assert len(want) > 20
    else:  # several indexes: each has windows of its own length; what lies whole in a text is found all the same
        got = {(r.doc_id, r.item_id) for r in dc.contaminated(frame, bench, chars=chars).collect()}
        sure = {(d, i) for d, text in docs for i, item in items if f" {' '.join(dc.words(item))} " in f" {' '.join(dc.words(text))} "}
        assert sure and sure <= got
        kept = {r.doc_id for r in dc.drop_contaminated(frame, bench, chars=chars).collect()}
        assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_edges(spark):
    item = "What is the name of the red river that runs by the old mill? It is called the Varn."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (1, item)], "item_id long, text string")
    filler = "some quite ordinary words that stand before and after everything else here "
    rows = [(1, filler * 40 + item.upper() + filler * 3), (2, None), (3, ""), (None, item), (5, filler), (6, " ".join(item.split()[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # An item without an id is one like any other.
    got = sorted(str((r.doc_id, r.item_id, r.overlap)) for r in dc.contaminated(docs, items).collect())
    assert got == sorted(map(str, [(1, 1, 1.0), (1, None, 1.0), (None, 1, 1.0), (None, None, 1.0)]))
    assert {r.doc_id for r in dc.drop_contaminated(docs, items).collect()} == {2, 3, 5, 6}
    assert dc.contaminated(docs, items.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.question_and_answer("Q one? Answer: two") == ("Q one?", "two")


def test_decontamination_maps_whole_rows(spark):
    """No function of the text alone, for which Spark keeps the rows that wait; columns of all kinds come back as they were."""
    item = "What is the name of the red river that runs by the old mill? It is called the Varn."
    docs = spark.sql("""select id, decode(text, 'utf-8') as `the ``text`, text as raw, id as as_text, map('a', array(id, null)) as m, named_struct('x', cast(id as decimal(20, 3)), 'y', cast(null as string)) as s,
        timestamp'2024-03-31 02:30:00' as t, timestamp_ntz'2024-03-31 02:30:00.000001' as n, date'0999-01-01' as d, interval '1' day as i, float('nan') as f, null as v
        from values (1L, cast('the sea' as binary)), (2L, null), (3L, x''), (null, cast('the sea' as binary)), (4L, cast(repeat('ö ', 30000) as binary)) as r(id, text)""")
    bad = docs.where("id = 1").withColumns({"id": F.lit(9).cast("long"), "the `text": F.lit(f"so {item} then"), "raw": F.lit(f"so {item} then").cast("binary")})
    items = spark.createDataFrame([(1, item), (2, "the boat of the old man lay there in the harbour all winter long")], "item_id long, text string")
    for chars in (1, dc.INDEX_CHARS):
        for column in ("the `text", "THE `Text", "raw"):
            left = dc.drop_contaminated(docs.union(bad).drop("v") if chars == 1 else docs.union(bad), items, text_col=column, chars=chars)
            plan = left._jdf.queryExecution().toString()
            assert "MapInArrow" in plan and "EvalPython" not in plan
            assert left.dtypes == (docs.drop("v") if chars == 1 else docs).dtypes
            assert sorted(map(str, left.collect())) == sorted(map(str, (docs.drop("v") if chars == 1 else docs).collect()))


def slow_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for rule, _ in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


@needs_tables
def test_url_rules(spark, tables):
    odd = [None, "", "x", "HTTP://A.Example.NET/en/x?y=1#z", "http://net", "http://net/", "http://a.net?x/", "a://b://c/d", "http://xnet/en", "http://example.com/de", "http://É.org/fr/#a", "://org/fr/x\ny?q"]
    rows = [(None, odd[-1])] + list(enumerate(odd))
    df = spark.createDataFrame(rows, "page_id long, url string").unionByName(tables["pages"].select("page_id", "url"))
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in url_filter.filter_urls(df).collect())
    want = sorted((str(r.page_id), *map(str, slow_judge(r.url)[:2]), str(slow_judge(r.url)[2])) for r in df.collect())
    assert got == want
    said = dict(url_filter.RULES)
    assert all(r.verdict == said[r.rule] for r in url_filter.filter_urls(df).where("rule is not null").collect())
    assert {r.verdict for r in url_filter.filter_urls(df.where("url = 'x'")).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    start, trees = url_filter.boost(x, y, trees=40)
    score = start + 0.3 * sum(t.predict(x) for t in trees)
    assert np.mean((score > 0) == y) > 0.95
    assert url_filter.boost(x[:0], y[:0]) == (0.0, [])
    noise = rng.integers(0, 2, 600).astype(float)
    assert len(url_filter.boost(x, noise, held=np.arange(600) % 3 == 0)[1]) < len(url_filter.boost(x, y, held=np.arange(600) % 3 == 0)[1])


def test_url_trees_learn_from_the_words_of_an_address(spark):
    """Held-out accuracy of each suffix, and compiled columns that equal the trees."""
    rng = random.Random(9)
    rules = (("net/", "block"), ("org/", "allow"), ("a.net/", "allow"), ("com/", "block"), ("b.com/", "allow"))
    rows = []
    for k in range(3000):
        bad = rng.random() < 0.5
        word = "".join(rng.choices("abcdefgh", k=6)) + ("".join(rng.choices("0123456789", k=7)) if bad else "")
        top = rng.choice(["com", "net", "info"])
        zone = "" if bad else {"net": "a.", "com": "b.", "info": "c."}[top]
        rows.append((k, f"http://{word}.{zone}{top}/{'x/' * (4 if bad else 1)}p", bad))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = url_filter.filter_urls(pages, rules).join(pages, "page_id").where("rule is null").collect()
    assert len(got) > 800 and np.mean([(r.verdict == "block") == r.bad for r in got]) > 0.95
    valued, names = url_filter.valued_urls(pages, rules)
    judge = url_filter.learn(valued, names)
    assert judge.trees and set(judge.shares) == {"com", "net"}
    table = valued.withColumn("s", judge.score()).toPandas()
    x = np.column_stack([table[[f"f_{n}" for n in names]].to_numpy(float), [judge.shares.get(s, 0.5) for s in table["suffix"]]])
    assert table["s"].to_numpy() == pytest.approx(1 / (1 + np.exp(-(judge.start + judge.rate * sum(t.predict(x) for t in judge.trees)))))


def test_a_hot_url_is_one_row_of_the_sample(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://a.net/").otherwise(F.concat(F.lit("http://h"), "id", F.lit(".net/x"))).alias("url"), F.lit(1.0).alias("f_length"), F.lit("s").alias("suffix"))
    seen = []
    boost = url_filter.boost
    try:
        url_filter.boost = lambda x, y, **more: seen.append(len(y)) or boost(x, y, **more)
        assert url_filter.filter_urls(pages, sample=500).count() == 3000
    finally:
        url_filter.boost = boost
    assert seen == [500]


def test_suffix_shares_come_from_other_folds():
    y = np.array([1.0, 1, 0, 0, 1, 1])
    rows, shares = url_filter.suffix_shares(["net", "net", "net", "net", "com", "com"], y, np.array([0, 0, 1, 1, 0, 1]))
    assert rows.tolist() == [5 / 12, 5 / 12, 7 / 12, 7 / 12, 0.5, 0.5] and shares == {"net": 0.5}


def test_fold_is_crc32(spark):
    import zlib

    rows = [(k,) for k in (0, 7, 123456789, -5, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "doc_id long").select(fold("doc_id", 4)).collect()]
    assert got == [None if k is None else zlib.crc32(str(k).encode()) % 4 for (k,) in rows]


@needs_tables
def test_pipeline_against_its_parts(spark, tables):
    import corpus_pipeline

    from textloom.llm import secrets, simhash

    docs = tables["documents"]
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in state.collect()}
        state = stage(spark, state, SF)
        assert state.columns == docs.columns, name
        after = {r.doc_id: r for r in state.collect()}
        state = spark.createDataFrame(list(after.values()), docs.schema)
        gone = set(before) - set(after)
        if name == "near duplicates":
            whole = spark.createDataFrame(list(before.values()), docs.schema)
            assert gone == {r.doc_id for r in simhash.near_duplicates(whole).collect() if r.doc_id != r.component_id}
        elif name == "decontamination":
            items = [dc.shingles(dc.words(r.text)) for r in tables["benchmark"].collect()]
            own = {k: dc.shingles(dc.words(r.text)) for k, r in before.items()}
            assert gone == {k for k, s in own.items() if any(len(i & s) >= 0.8 * len(i) for i in items)}
        elif name == "secrets":
            assert not gone and all(after[k].text == secrets.redact(before[k].text) and after[k].n_chars == len(after[k].text) for k in before)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(after)

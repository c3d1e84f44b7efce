"""License scan, language ID and the two classifiers."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from pixelframe.llm import hashed_text, language_id, licenses, quality, toxicity
from pixelframe.llm.hashed_text import LinearScorer
from tests.llm.conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTICES = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0, cc-by-nc", "under the mit\nLICENSE under the mit license", "no notice here"]


def brute(text):
    found, starts, labels = WORD.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        parts = phrase.split()
        for k in range(len(found) - len(parts) + 1):
            if found[k : k + len(parts)] == parts:
                starts.append(k)
                labels.add(label)
    return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_scan_by_brute_force(spark, docs, rows):
    extra = [(1000 + i, t, None, None, None, 0.0, "") for i, t in enumerate(NOTICES)]
    frame = docs.union(spark.createDataFrame(extra, docs.schema))
    found = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.digest(licenses.scan(frame)).collect())))
    assert found == sorted(str((r[0], *brute(r[1]))) for r in [*rows, *extra])


@pytest.mark.parametrize(("text", "label", "edits"), [
    ("released under teh mit licence today", "mit", 3), ("x gnu genral public license y", "gpl", 1), ("mozila public licence", "mpl", 2), ("all rights reservd", "all-rights-reserved", 1),
])
def test_fuzzy_notices(text, label, edits):
    spans = licenses.Scanner().fuzzy(text)
    own = [s for s in spans if s[0] == label]
    if edits > next(n.edits for n in licenses.NOTICES if n.label == label):
        assert not own
    else:
        assert own and own[0][3] <= edits and text[own[0][1] : own[0][2]] == own[0][4]


@pytest.mark.parametrize(("text", "labels"), [
    ("licensed under cc by sa 4 0", []), ("licensed under cc by nd", []), ("licensed under cc by ncx", []), ("licensed under cc by nc sa", ["cc-by-nc"]), ("licenced under cc by nc", ["cc-by-nc"]),
    ("under the mpl license", []), ("under the permit license", []), ("under the mti license", []), ("under te mit licence", ["mit"]),
    ("apache license version 1 1", []), ("apache license version 1 0", []), ("apache license version 20", []), ("apache licence versoin 2", []), ("apache licence version 2", ["apache-2"]),
    ("gnu affero general public license", []), ("affero general public license", []), ("gnu lesser general public license", ["lgpl"]), ("gnu lesser general public licence", ["lgpl"]), ("gnu generall public license", ["gpl"]),
    ("creative commons attribution commercial", []), ("creative commons attribution sharealike", []), ("creative commons attribution non commercial", ["cc-by-nc"]), ("creative commons atribution noncomercial", ["cc-by-nc"]),
    ("eclipse public license", []), ("no rights reserved", []), ("some rights reserved", []), ("mozila public license", ["mpl"]),
])
def test_no_license_gets_anothers_label(text, labels):
    for whole in (text, f"lorem {text} ipsum"):
        assert sorted({s[0] for s in licenses.Scanner().fuzzy(whole)}) == labels


def test_every_bounded_edit_is_found():
    """Pigeonhole: whatever the edits, some piece survives; the exhaustive search finds just as much."""
    rng, scanner, found = random.Random(5), licenses.Scanner(), 0
    for notice in licenses.NOTICES:
        for _ in range(30):
            text = list(notice.text)
            for _ in range(rng.randint(0, notice.edits)):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice(["", "q", text[at] + "q"])
            text = "lorem ipsum " + "".join(text) + " dolor"
            wanted = any(True for n in licenses.NOTICES if n.label == notice.label for _ in exhaustive_matches(n, text))
            found += wanted
            assert wanted == any(s[0] == notice.label for s in scanner.fuzzy(text)), text
    assert found > 200


def exhaustive_matches(notice, text):
    """(start, end, edits) of every substring within the notice's edits, none of them in its fixed parts."""
    never, size = 1 << 20, len(notice.text)
    fixed = [(a, b) for a, b, f in notice.parts() if f]
    inside = {k for a, b in fixed for k in range(a, b)}
    closed = {k for a, b in fixed for k in range(a + 1, b)} | {0 for a, _ in fixed if a == 0} | {size for _, b in fixed if b == size}  # places that take no inserted character
    heads = {a for a, _ in fixed if a == 0 or notice.text[a - 1] == " "}
    tails = {b - 1 for _, b in fixed if b == size or notice.text[b] == " "}
    for start in range(len(text) + 1):
        row = [0]
        for k in range(size):
            row.append(never if k in inside else row[k] + 1)
        for end in range(start, min(len(text), start + size + notice.edits) + 1):
            if end > start:
                at = end - 1
                new = [never if 0 in closed else row[0] + 1]
                for k in range(size):
                    same = notice.text[k] == text[at]
                    if k in inside:
                        same &= (k not in heads or at == 0 or text[at - 1] == " ") and (k not in tails or end == len(text) or text[end] == " ")
                        best = row[k] if same else never
                    else:
                        best = min(row[k] + (not same), new[k] + 1)
                    new.append(min(best, never if k + 1 in closed else row[k + 1] + 1))
                row = new
            if row[-1] <= notice.edits:
                yield start, end, row[-1]


def test_crowded_edited_notices_by_exhaustive_search():
    """Spans don't overlap, tell their true edits, and every match overlaps one that is no worse."""
    rng, scanner = random.Random(6), licenses.Scanner()
    texts = ["under te mit license under the mit license", "mozila public license x mozilla public license"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            part = list(rng.choice(licenses.NOTICES).text)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice(["", "q", part[at] + "q"])
            parts.append("".join(part))
        texts.append(" ".join(rng.choice(["", " "]).join(parts).split()))
    for text in texts:
        found = {}
        for label, start, end, edits, matched in scanner.fuzzy(text):
            assert matched == text[start:end]
            found.setdefault(label, set()).add((start, end, edits))
        for notice in licenses.NOTICES:
            own = found.get(notice.label, set())
            true = {(start, end): edits for start, end, edits in exhaustive_matches(notice, text)}
            mine = sorted(s for s in own if true.get(s[:2]) == s[2])
            if sum(n.label == notice.label for n in licenses.NOTICES) == 1:
                assert len(mine) == len(own) and all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))
            for (start, end), edits in true.items():
                assert any(s[0] < end and s[1] > start and s[2] <= edits for s in mine)


@pytest.mark.parametrize("unit", ["under te mit license ", "license ", "under the mit license ", "gnu publik "])
def test_long_texts_of_notices_take_linear_time(unit):
    scanner, took = licenses.Scanner(), []
    for size in (200_000, 800_000):
        text = unit * (size // len(unit))
        began = time.perf_counter()
        spans = scanner.fuzzy(text.strip())
        starts, _ = scanner.base(b" " + text.encode())
        took.append(time.perf_counter() - began)
    repeats = len(text) // len(unit)
    assert len(spans) == (repeats if "mit license" in unit else 0) and len(starts) == (repeats if unit.startswith("under the") else 0)
    assert took[1] < 12 * took[0] + 1


def test_scan_of_nothing(empty):
    assert licenses.digest(licenses.scan(empty)).count() == 0


def texts(rng, syllables, n):
    return [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 80))) for _ in range(n)]


def test_language_profiles(spark, rows):
    rng = random.Random(1)
    languages = {"aa": "ka to mi ru se no".split(), "bb": "sch ung ei ber lich".split(), "cc": "éau oux tre ion ç".split()}
    data = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, s in languages.items() for t in texts(rng, s, 60))]
    frame = spark.createDataFrame([*data, (900, "12 34 !", "aa"), (901, None, "aa"), (902, "", None), (None, "ka to mi ka", None)], "doc_id long, text string, lang string")
    profiles = language_id.learn(frame)
    assert sorted(profiles) == ["aa", "bb", "cc"] and all(len(p) <= 300 for p in profiles.values())
    found = {r["doc_id"]: r for r in language_id.predictions(language_id.identify(frame, profiles)).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in data)
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in data)
    assert [found[i]["lang_pred"] for i in (900, 901, 902, None)] == ["und", "und", "und", "aa"]
    assert found[900]["score"] == 0 and 0 < found[0]["score"] <= 1
    nothing = language_id.learn(frame.where("false"))
    assert nothing == {} and {r["lang_pred"] for r in language_id.identify(frame, nothing).collect()} == {"und"}
    assert language_id.identify(frame.where("false"), profiles).count() == 0


def test_held_out_texts_are_never_learnt(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    frame = spark.createDataFrame([(i, "zz " * 20, "xx") for i in held], "doc_id long, text string, lang string")
    assert language_id.learn(frame) == {}
    labels = spark.createDataFrame([(i, 1, 1) for i in held], "doc_id long, quality int, toxic int")
    assert hashed_text.training_sample(frame, labels, "toxic", 100, False) == []


def test_ngrams_by_definition(monkeypatch):
    text = "Élan vital, 12 ÉLAN!"
    letters = " élan vital élan "
    expected = {}
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            if gram != " " and " " not in gram[1:-1]:
                expected[gram] = expected.get(gram, 0) + 1
    for piece in (1 << 20, 5):
        monkeypatch.setattr(language_id, "PIECE", piece)
        keys, counts = language_id.ngrams(language_id.letters_of(text.encode()))
        found = {}
        for key, n in zip(keys.tolist(), counts.tolist()):
            gram = "".join(chr(key >> s & 0x1FFFFF) for s in (42, 21, 0) if key >> s)
            found[gram] = n
        assert found == expected


def sentences(n, rng, term_rate):
    out = []
    for i in range(n):
        text, toxic = words(rng, 25), i % 4 == 0
        if toxic:
            text.append("scumbag")
        if rng.random() < (term_rate if toxic else 0.05):
            text.append("women")
        elif rng.random() < 0.2:
            text.append("men")
        out.append((i, " ".join(text), int(toxic)))
    return out


def sample(data):
    featurizer = hashed_text.Featurizer(False)
    return [(i, y, featurizer(t.encode()), 1.0) for i, t, y in data]


def test_counterfactual_penalty_levels_identity_terms():
    data = sample(sentences(600, random.Random(2), 0.8))
    gaps = []
    for strength in (0.0, 1.0):
        weights, bias = toxicity.fit(data, counterfactual=strength)
        linear = LinearScorer(weights, False)
        gaps.append(abs(linear(b"women") - linear(b"men")))
        assert linear(b"you scumbag") + bias > 0 > linear(b"women are here") + bias
    assert gaps[1] < 0.2 * gaps[0]


def test_toxicity_query(spark):
    rng = random.Random(3)
    data = sentences(800, rng, 0.2)
    frame = spark.createDataFrame([(i, t) for i, t, _ in data] + [(5000, None), (5001, ""), (None, "you scumbag")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(0, 1), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    found = {r["doc_id"]: r for r in toxicity.predictions(toxicity.score(frame, model)).collect()}
    held = [(i, y) for i, _, y in data if found[i]["held_out"]]
    assert np.mean([found[i]["predicted"] == y for i, y in held]) > 0.97
    assert found[5000]["score"] == found[5001]["score"] < 0.3 and found[None]["predicted"] == 1 and not found[None]["held_out"]
    column = frame.select("doc_id", toxicity.scorer(spark, model)("text").alias("s")).collect()
    assert all(abs(r["s"] - found[r["doc_id"]]["score"]) < 1e-9 for r in column)
    unlabelled = toxicity.train(frame, labels.where("false"))
    assert {round(r["score"], 6) for r in toxicity.score(frame, unlabelled).collect()} == {toxicity.LOW_RATE}
    assert toxicity.score(frame.where("false"), model).count() == 0


def test_ordinal_grades(spark):
    rng = random.Random(4)
    marks = {0: "###", 1: "ok", 2: "good", 3: "fine"}
    data = [(i, " ".join([*words(rng, 20), *([marks[i % 4]] * 3)]), i % 4) for i in range(900)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in data] + [(5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, quality int")
    model = quality.train(frame, labels)
    assert model.grades == (0, 1, 2, 3) and list(model.thresholds) == sorted(model.thresholds)
    found = {r["doc_id"]: r for r in quality.selections(quality.score(frame, model)).collect()}
    held = [(i, y) for i, _, y in data if found[i]["held_out"]]
    assert np.mean([abs(found[i]["expected_grade"] - y) for i, y in held]) < 0.6
    assert np.mean([found[i]["selected"] == (y >= 2) for i, y in held]) > 0.95
    assert found[5000] is not None and 0 <= found[5000]["expected_grade"] <= 3
    one = quality.train(frame, labels.where("quality = 1"))
    assert {r["tail_probability"] for r in quality.score(frame, one).collect()} == {1.0}
    column = frame.select("doc_id", quality.scorer(spark, model)("text").alias("s")).collect()
    assert all(abs(r["s"] - found[r["doc_id"]]["tail_probability"]) < 1e-9 for r in column)
    assert quality.score(frame.where("false"), model).count() == 0


def test_repetition_is_a_feature():
    shares = hashed_text.Featurizer(True).shares
    assert set(shares(b"so so so so so so")) != set(shares(b"so on it goes for now"))


def brute_language(text, profiles, size):
    """The method by its definition, with counters and lists."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    counts = Counter()
    for word in letters.split():
        padded = f" {word} "
        for n in (1, 2, 3):
            counts.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    if not counts:
        return "und", 0.0
    code = lambda g: [ord(c) for c in g.rjust(3, "\0")]
    top = sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]
    places = {lang: {key: i for i, key in enumerate(grams)} for lang, grams in profiles.items()}

    def number(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value

    distance = {lang: sum(abs(i - own[number(g)]) if number(g) in own else size for i, g in enumerate(top)) for lang, own in places.items()}
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (size * len(top))


def test_language_by_brute_force(spark, rows):
    rng = random.Random(9)
    alphabets = {"aa": "ka to mi ru se no".split(), "bb": "ka to mi sch ung ei".split(), "cc": "ka oux tre ion \u00e7".split()}
    data = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, s in alphabets.items() for t in texts(rng, s, 25))]
    profiles = language_id.learn(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    asked = [(i, t) for i, t, _ in data] + [(1000 + i, r[1]) for i, r in enumerate(rows)] + [(2000, "ka"), (2001, "to ka"), (2002, "xyz"), (2003, "ka\u00e7 ka\u00e7")]
    known = language_id.Profiles(profiles)
    for _, text in asked:
        lang, score = brute_language(text, profiles, language_id.PROFILE)
        assert known.predict((text or "").encode()) == (lang, pytest.approx(score, abs=1e-12))


def test_ties_in_distance_go_to_the_smaller_name():
    grams = [ord(c) for c in "abc"]
    assert language_id.Profiles({"zz": grams, "yy": grams}).predict(b"abc")[0] == "yy"


@pytest.mark.parametrize("text", ["word " * 300_000, "x" * 1_500_000])
def test_very_long_texts(spark, text):
    frame = spark.createDataFrame([(1, text), (2, "ka to mi")], "doc_id long, text string")
    profiles = {"aa": [ord("k"), ord("a")], "bb": [ord("w"), ord("x")]}
    assert {r["lang_pred"] for r in language_id.identify(frame, profiles).where("doc_id = 1").collect()} == {"bb"}
    assert licenses.digest(licenses.scan(frame)).where("doc_id = 1").first()["n_words"] == len(text.split())
    weights = np.zeros(hashed_text.DIMENSIONS)
    weights[hashed_text.word_features(text.split()[0].encode())[0]] = 2.0
    assert toxicity.score(frame, (weights, 0.0)).where("doc_id = 1").first()["score"] > 0.88
    model = quality.OrdinalModel(weights, (0.0,), (0, 1))
    assert quality.score(frame, model).where("doc_id = 1").first()["tail_probability"] > 0.88


def logistic_objective(w, b, data, pairs):
    """Weighted mean loss, l1 norm, mean squared score change; ``w`` by feature number."""
    loss = np.mean([weight * np.logaddexp(0, -(2 * (y > 0) - 1) * (w[f].sum() + b)) for _, y, f, weight in data])
    return loss + toxicity.L1 * np.abs(w).sum() + toxicity.COUNTERFACTUAL * np.mean([(v @ w[i]) ** 2 for i, v in pairs])


def test_toxicity_model_against_a_reference_solver():
    """Plain proximal gradient on dense columns, many small steps."""
    data = sample(sentences(160, random.Random(12), 0.8))
    pairs = [p for _, _, f, _ in data for p in toxicity.swaps(f)]
    w, b = toxicity.fit(data)
    seen = Counter(int(i) for _, _, f, _ in data for i in f)
    live = sorted({i for i, n in seen.items() if n >= 3} | {int(i) for index, _ in pairs for i in index})
    at = {i: k for k, i in enumerate(live)}
    x, d = np.zeros((len(data), len(live))), np.zeros((len(pairs), len(live)))
    for r, (_, _, f, _) in enumerate(data):
        x[r, [at[int(i)] for i in f if int(i) in at]] = 1
    for r, (index, value) in enumerate(pairs):
        d[r, [at[int(i)] for i in index]] = value
    y = np.array([float(label > 0) for _, label, _, _ in data])
    own, offset = np.zeros(len(live)), 0.0
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 / len(data) + 2 * toxicity.COUNTERFACTUAL * np.linalg.norm(d, 2) ** 2 / len(d))
    for _ in range(30_000):
        residual = (1 / (1 + np.exp(-(x @ own + offset))) - y) / len(y)
        moved = own - step * (x.T @ residual + 2 * toxicity.COUNTERFACTUAL / len(d) * d.T @ (d @ own))
        own, offset = np.sign(moved) * np.maximum(np.abs(moved) - step * toxicity.L1, 0), offset - 2 * residual.sum()
    best = np.zeros(hashed_text.DIMENSIONS)
    best[live] = own
    start = logistic_objective(np.zeros(hashed_text.DIMENSIONS), np.log(y.mean() / (1 - y.mean())), data, pairs)
    mine, reference = logistic_objective(w, b, data, pairs), logistic_objective(best, offset, data, pairs)
    assert mine - reference <= 0.03 * (start - reference)


def ordinal_objective(w, thresholds, data, grades):
    total = 0.0
    for _, grade, f, weight in data:
        reach = [1.0, *(1 / (1 + np.exp(-(w[f].sum() - t))) for t in thresholds), 0.0]
        k = grades.index(grade)
        total -= weight * np.log(max(reach[k] - reach[k + 1], 1e-12))
    return total / len(data) + quality.L1 * np.abs(w).sum()


def test_ordinal_model_against_a_reference_solver():
    rng = random.Random(14)
    marks, featurizer = {0: "###", 1: "ok", 2: "good"}, hashed_text.Featurizer(False)
    data = [(i, i % 3, featurizer(" ".join([*words(rng, 6), marks[i % 3] if rng.random() < 0.8 else "ok"]).encode()), 1.0) for i in range(120)]
    model = quality.fit(data)
    seen = Counter(int(i) for _, _, f, _ in data for i in f)
    live = sorted(i for i, n in seen.items() if n >= 3)
    at = {i: k for k, i in enumerate(live)}
    x = np.zeros((len(data), len(live)))
    for r, (_, _, f, _) in enumerate(data):
        x[r, [at[int(i)] for i in f if int(i) in at]] = 1
    level = np.array([grade for _, grade, _, _ in data])
    own, cuts = np.zeros(len(live)), np.array([-0.7, 0.7])
    step = 1 / (np.linalg.norm(x, 2) ** 2 / len(data))
    for _ in range(20_000):
        score = x @ own
        upper = 1 / (1 + np.exp(-(np.append(cuts, 50.0)[level] - score)))
        lower = 1 / (1 + np.exp(-(np.insert(cuts, 0, -50.0)[level] - score)))
        mass = np.maximum(upper - lower, 1e-12)
        gradient = x.T @ (1 - upper - lower) / len(level)
        slope = [(np.where(level == k, upper * (1 - upper) / mass, 0) - np.where(level == k + 1, lower * (1 - lower) / mass, 0)).sum() / len(level) for k in (0, 1)]
        moved = own - step * gradient
        own, cuts = np.sign(moved) * np.maximum(np.abs(moved) - step * quality.L1, 0), cuts + np.array(slope)
    best = np.zeros(hashed_text.DIMENSIONS)
    best[live] = own
    assert list(model.thresholds) == sorted(model.thresholds)
    start, mine, reference = (ordinal_objective(v, c, data, [0, 1, 2]) for v, c in ((0 * best, (-0.7, 0.7)), (model.weights, model.thresholds), (best, cuts)))
    assert mine - reference <= 0.03 * (start - reference)


def test_labels_that_are_no_grades_are_refused(spark):
    frame = spark.createDataFrame([(i, "text") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i) for i in range(200)], "doc_id long, quality int")
    with pytest.raises(ValueError, match="not a graded label"):
        quality.train(frame, labels)


def test_repeated_ids_give_one_training_row(spark):
    frame = spark.createDataFrame([(i % 5, f"text {i % 7} of many") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 3, "doc_id long, toxic int")
    found = hashed_text.training_sample(frame, labels, "toxic", 100, False)
    assert len(found) == len({i for i, *_ in found}) <= 5


def test_samples_are_bounded_in_bytes(spark):
    assert hashed_text.shares_within({}, 10) == hashed_text.shares_within({5: 4, 9: 6}, 10) == hashed_text.SLOTS
    assert hashed_text.shares_within({9: 6, 5: 4, 11: 1}, 10) == 11 and hashed_text.shares_within({5: 40, 9: 6}, 10) == 9
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(20 + i))) for i in range(200)]
    frame, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    whole = hashed_text.training_sample(frame, labels, "toxic", 1_000, False)
    size = sum(4 * len(f) + 8 for _, _, f, _ in whole)
    part = hashed_text.training_sample(frame, labels, "toxic", 1_000, False, sample_bytes=size // 3)
    assert size // 4 < sum(4 * len(f) + 8 for _, _, f, _ in part) <= size // 3
    features = {i: f.tobytes() for i, _, f, _ in whole}
    assert all(features[i] == f.tobytes() for i, _, f, _ in part)  # of a document all or nothing
    for found in (whole, part):  # the classes keep their share
        shares = [sum(w for _, y, _, w in found if y == c) for c in (0, 1)]
        known = [sum(1 for _, y, _, _ in whole if y == c) for c in (0, 1)]
        assert abs(shares[0] / sum(shares) - known[0] / sum(known)) < 1e-9
    few = hashed_text.training_sample(frame, labels, "toxic", 20, False)
    assert 15 < len(few) < 70

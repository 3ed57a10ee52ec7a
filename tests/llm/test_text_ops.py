"""Small fixtures with nulls, empty and long texts, ties, repeats, clashing columns; brute force where SQL cannot."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import decontaminate as clean
from quillon.llm import html_text, jaccard, langid, licenses, line_dedup, packing, quality, suffix_dedup, toxicity
from quillon.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, h1 string, value double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1.0) for i, t in rows], SCHEMA)


def prose(seed, n, vocab=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


ODD = [(None, "a b c"), (100, None), (101, ""), (102, " \n\t "), (103, "é ß " * 5), (103, "é ß " * 5), (104, "long " * 60_000)]


# ---- quality ----


def test_stats_by_brute_force():
    text = "one two three one two three four\n\n x \n x # $\n x "
    words = text.split()
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 3)}
    assert quality.text_stats(text) == (len(words), sum(map(len, words)), 2, 1, len(hit), 5)
    assert quality.text_stats(None) == (0, 0, 0, 0, 0, 1)


def test_rules_learn_and_emit(spark):
    docs = frame(spark, [(1000 + k, prose(k, 120) + (" ###" * 40 if k % 3 == 0 else "")) for k in range(150)] + ODD)
    labels = spark.createDataFrame([(1000 + k, int(k % 3 != 0)) for k in range(150)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    assert rules and all(r.precision >= 0.95 for r in rules)
    got = {r.doc_id: r for r in quality.judge(docs, rules).collect() if r.doc_id is not None}
    assert all(got[1000 + k].kept == (k % 3 != 0) for k in range(150))
    assert got[100].base_failed and got[101].base_failed and not got[100].kept and quality.fit(docs, labels.where("false")) == []
    assert quality.judge(docs.where("false"), rules).count() == 0


def test_list_of_several_rules():
    def draw(seed):
        x = np.random.default_rng(seed).random((4000, len(quality.FEATURES)))
        return x, (x[:, 2] > 0.8) | (x[:, 1] <= 0.15) | ((x[:, 3] > 0.6) & (x[:, 5] <= 0.4))

    rules = quality.learn(*draw(1))
    assert len(rules) >= 3 and max(len(r.tests) for r in rules) >= 2
    x, bad = draw(2)
    found = np.any([r.mask(x) for r in rules], axis=0)
    assert (found == bad).mean() >= 0.96 and bad[found].mean() >= 0.97


def test_verdicts_follow_the_list(spark):
    def text(k):
        words = prose(k, random.Random(k).randrange(60, 400), 5000).split()  # lengths tell nothing
        if k % 7 == 0:
            words = [w[:-2] + "##" for w in words]
        if k % 7 == 1:
            words = [w + "longerthanusual" for w in words]
        lines = [" ".join(words[a : a + 9]) for a in range(0, len(words), 9)]
        return "\n".join(lines + lines[: len(lines) // 3] if k % 7 == 2 else lines)

    rows = [(1000 + k, text(k)) for k in range(700)]
    labels = spark.createDataFrame([(1000 + k, int(k % 7 > 2)) for k in range(600)], "doc_id long, quality int")
    rules = quality.fit(frame(spark, rows), labels)
    assert len(rules) >= 3 and len({t[0] for r in rules for t in r.tests}) >= 3
    want = {}
    for i, t in rows:
        s = dict(zip(quality.STATS, quality.text_stats(t), strict=True))
        value = {k: s[a] / (max(s[b], 1) if b else 1) for k, (a, b) in quality.FEATURES.items()}
        hit = any(all(value[f] <= v if sign == "<=" else value[f] > v for f, sign, v in r.tests) for r in rules)
        want[i] = not hit and s["n_words"] >= 50 and 2 * s["n_repeat_words"] <= s["n_words"]
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows), rules).collect()}
    assert got == want and all(got[1000 + k] == (k % 7 > 2) for k in range(600, 700))


# ---- language ----


def test_language(spark):
    rows = [(k, " ".join(random.Random(k).choices(["the", "and", "house", "with"] if k % 2 else ["und", "der", "haus", "mit"], k=40)), "en" if k % 2 else "de") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    got = langid.identify(docs, model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(frame(spark, ODD + [(105, "12 34")]), model).collect()}
    assert odd[100].lang_pred == odd[101].lang_pred == odd[105].lang_pred == "und" and odd[100].score == 0
    assert langid.identify(docs, langid.fit(docs.where("false"))).first().lang_pred == "und"


def plain_bucket(gram, bits):
    h = 0
    for n, c in enumerate(gram, start=1):
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) + n)
    return ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 32 - bits


def plain_counts(text, orders, bits):
    low = text.lower()
    return Counter(plain_bucket(low[i : i + n], bits) for n in orders for i in range(len(low) - n + 1))


@pytest.mark.parametrize("chunk", [5, 64, 1 << 18])
def test_grams_are_those_of_each_text(monkeypatch, chunk):
    monkeypatch.setattr(langid, "_CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["".join(rng.choices("abcÄß中\U0001f600 .", k=rng.choice([0, 1, 2, 3, 7, 40, 300]))) for _ in range(60)]
    got = [Counter() for _ in texts]
    for row, bucket, counts in langid.grams(texts, (1, 3), 12):
        for r, b, n in zip(row.tolist(), bucket.tolist(), counts.tolist(), strict=True):
            got[r][b] += n
    assert got == [plain_counts(t, (1, 3), 12) for t in texts]


def test_language_is_naive_bayes(spark):
    rng = random.Random(8)
    words = {"a": "ab ba bab aab".split(), "b": "ab bc cb abc".split(), "c": "cd dc ccd ab".split()}
    rows = [(k, " ".join(rng.choices(words["abc"[k % 3]], k=rng.randrange(1, 12))), "abc"[k % 3] if k % 5 else None) for k in range(90)]
    docs = spark.createDataFrame(rows + [(500, "", "a"), (501, None, "b")], "doc_id long, text string, lang string")
    model = langid.fit(docs, orders=(1, 2), bits=10, alpha=0.5)
    sums, seen = {x: Counter() for x in "abc"}, Counter()
    for i, t, x in rows + [(500, "", "a")]:
        if x:
            sums[x] += plain_counts(t, (1, 2), 10)
            seen[x] += 1
    for r in langid.identify(docs, model).collect():
        if not r.text:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        counts = plain_counts(r.text, (1, 2), 10)
        like = {x: sum(n * math.log((sums[x][b] + 0.5) / (sum(sums[x].values()) + 512)) for b, n in counts.items()) for x in "abc"}
        post = {x: v * min(1, 60 / sum(counts.values())) + math.log(seen[x] / sum(seen.values())) for x, v in like.items()}
        best = max(sorted(post), key=post.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - post[best]) for v in post.values()), rel=1e-4)
    with pytest.raises(ValueError):
        langid.fit(docs, max_langs=2)


# ---- line dedup ----


def test_lines(spark):
    line = "This very line stands in many documents, again and again."
    rows = [(k, f"a{k}\n {line.upper() if k % 2 else line}\t\nend") for k in range(6)] + ODD
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert all(got[k].n_dropped == (k < 5) and line.lower() not in got[k].text.lower() for k in range(5))
    assert line.lower() in got[5].text.lower() and got[5].n_lines == 3
    assert got[100].text == "" and got[100].n_lines == 1 and got[103].text == "é ß " * 5 and got[5].h1 == "x"
    assert line_dedup.dedup_lines(frame(spark, []).where("false")).count() == 0


# ---- Jaccard ----


def brute_groups(rows, size, percent):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("crowd", [64, 2])
def test_groups_by_brute_force(spark, crowd):
    rng, rows = random.Random(3), [(0, None), (1, ""), (2, "a"), (3, "A"), (4, "a b c")]
    for g in range(8):
        base = prose(g, 80).split()
        for _ in range(12):
            w = base[:]
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    shared = prose(99, 30)
    rows += [(len(rows) + k, f"{shared} {prose(200 + k, 40)}") for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_groups(frame(spark, rows), size=4, percent=85, heavy_min=6, crowd=crowd).collect()}
    assert got == brute_groups(rows, 4, 85)


def test_signatures_meet_for_linked_sets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(2, 300))
        a = np.unique(rng.integers(1, 1 << 60, n, dtype=np.uint64))
        b = a[rng.random(len(a)) < 0.95]
        b = np.unique(np.concatenate([b, rng.integers(1, 1 << 60, int(rng.integers(0, 1 + n // 20)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(a) == len(b) == common or 100 * common < 85 * (len(a) + len(b) - common) or not common:
            continue
        heavy = np.sort(rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False))
        assert len(np.intersect1d(jaccard.signatures(a, heavy, 85), jaccard.signatures(b, heavy, 85)))


# ---- toxicity ----


def test_automaton_distance():
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(1, 8))) for _ in "ab")
        auto = toxicity.LevenshteinAutomaton(a, 2)
        state = auto.start()
        for c in b:
            state = auto.step(state, c)
        want = edit(a, b)
        assert auto.distance(state) == (want if want <= 2 else None)


def test_toxicity(spark):
    rng = random.Random(2)
    rows = [(k, prose(k, 60) + (f" you {rng.choice(['dreadfool', 'nastyface'])} there" if k % 4 == 0 else "")) for k in range(200)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    terms = set(lexicon.words) | set(lexicon.stems)
    assert any("dreadfool".startswith(t) for t in terms)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[k] >= 0.7) == (k % 4 == 0) for k in got)
    fixed = toxicity.Lexicon(words=("dreadfool",), worth={("dreadfool", 0): 0.95, ("dreadfool", 1): 0.9})
    score = lambda t: toxicity.score_matches(toxicity.Matcher(fixed).matches(t), fixed)
    assert score("you dreadfol man") >= 0.7 > score('he said "you dreadfool" to her') > 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(frame(spark, ODD), lexicon).collect())
    assert toxicity.fit(docs, labels.where("false")).words == ()


def test_toxicity_learns_every_pure_term(spark):
    rng = random.Random(5)
    bad = sorted({"".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(1200)})
    dealt = [w for w in bad for _ in range(10)]
    rng.shuffle(dealt)
    rows = [(k, prose(k, 40) + " " + " ".join(dealt[k // 2 :: 1200]) * (k % 2)) for k in range(2400)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(k, k % 2) for k in range(2400)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    held = [sum(w in t.split() for t in (x for k, x in rows if k % 2)) for w in bad[:20]]
    assert min(held) >= 6 and not [w for w in bad if lexicon.lookup(w) is None]
    # the screen of words lets every match through
    fixed = toxicity.Lexicon(words=tuple(bad[:40]))
    for w in bad[:40]:
        k = rng.randrange(8)
        assert all(fixed.lookup(x) == (w, 1) for x in (w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "a" + w[k + 1 :]))


# ---- licences ----


def test_licences(spark):
    mit = licenses.KNOWN[0][2]
    rows = [(1, "Copyright (c) 1999 Somebody\n\n" + mit.upper()), (2, mit.replace(",", " ;")), (3, mit + " more"), (4, "x\nReleased under the MIT Licence!\ny"), *ODD]
    known = licenses.known_digests(spark)
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(frame(spark, rows), known).collect()}
    assert got[1] == got[2] == "MIT" and got[3] is None and got[100] is None
    assert [(r.doc_id, r.line, r.license_id) for r in licenses.scan_notices(frame(spark, rows), known).collect()] == [(4, 1, "MIT")]


# ---- packing ----


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b >= n]
        if fit:
            b = min(fit)
            bins.remove(b)
            bins.append(b - n)
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randrange(3, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 80))]
        rows, n = packing.plan_bins(Counter(lengths), capacity)
        assert n == best_fit(lengths, capacity)
        held = Counter()
        for length, _, each, start, _, ranks in rows.tolist():
            for r in range(ranks):
                held[start + r // each] += length
        assert max(held.values()) <= capacity and sum(held.values()) == sum(lengths)


def test_other_tokenizer_files_take_the_plain_way(tmp_path):
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert packing._ranked_bytes(spec)
    swapped = [*spec["model"]["merges"][1::-1], *spec["model"]["merges"][2:]]
    others = {"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}, "model": {**spec["model"], "merges": swapped}}
    for key, value in others.items():
        path = str(tmp_path / f"{key}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({**spec, key: value}, f)
        assert not packing._ranked_bytes({**spec, key: value})
        encode, plain = packing._encoder(path), Tokenizer.from_file(path)
        for text in ["The Cat  sat at 12.30, it's THE end", "", " x\n\n y"]:
            assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(k, prose(k, random.Random(k).randrange(1, 900))) for k in range(40)] + ODD + [(200, "a<|endoftext|>b"), (201, "数学 \u0085 ﬁ 🙂 ١٢")]
    plain = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(frame(spark, rows), tokenizer_path=tokenizer_path(), capacity=128).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for k, (at, n) in enumerate(packing.cut(len(ids), 128)):
            want[i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 128
    assert len(places) == best_fit([r.length for r in got], 128)
    assert packing.pack(frame(spark, []).where("false"), tokenizer_path=tokenizer_path()).count() == 0


# ---- decontamination ----


def brute_hits(words, items, window):
    hit, found = set(), set()
    for item, w in items:
        for k in range(max(1, len(w) - window + 1)) if w else ():
            g = w[k : k + window]
            for p in range(len(words) - len(g) + 1):
                if words[p : p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    found.add(item)
    return hit, sorted(found, key=str)


def test_blocks_cut_like_one_block(spark):
    rng = random.Random(8)
    word = lambda k: f"w{k:04d}"
    items = [[word(100 * k + j) for j in range(20)] for k in range(6)]
    items += [[word(2000 + j) for j in range(10)], [word(2005 + j) for j in range(10)]]  # overlap by five words
    bench = spark.createDataFrame([(f"i{k}", " ".join(w)) for k, w in enumerate(items)], "item_id string, text string")
    own = lambda n: [word(5000 + rng.randrange(4000)) for _ in range(n)]
    docs = [
        items[0][:10] + items[1][:10] + own(4),  # 83 % of the words, of two blocks
        own(20) + [word(2000 + j) for j in range(15)] + own(20),
        own(20) + items[2][:5] + items[3][:12] + items[2][5:15] + own(20),  # the cut brings a window together
        own(30) + items[4][:10] + items[5][:10] + own(30),
        own(30),
    ]
    rows = [(k, " ".join(w)) for k, w in enumerate(docs)]
    rows += [(None, rows[1][1]), (None, rows[2][1]), (1, rows[3][1]), (1, rows[3][1]), (7, None), (7, ""), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda n: sorted((tuple(r) for r in clean.decontaminate(table, bench, block_bytes=n).collect()), key=str)
    one = by(8_000_000)
    assert by(400) == one and len(one) == len(rows) - 1
    assert not any(w in (t or "").split() for _, t in one for w in items[7])


def test_overlap_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        items = [(f"i{k}", [bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(0, 9))]) for k in range(4)]
        auto = clean.build([(i, b" ".join(w)) for i, w in items], window=4)
        words = [bytes([97 + rng.randrange(4)]) for _ in range(rng.randrange(40))]
        spans, found = clean.scan(words, auto)
        hit, names = brute_hits(words, items, 4)
        assert {p for a, b in spans for p in range(a, b)} == hit and sorted({auto.items[k] for k in found}) == names


def test_blocks_and_cuts(spark):
    bench = spark.createDataFrame([(k, prose(k + 500, 15)) for k in range(6)] + [(9, None), (10, "!!")], "item_id long, text string")
    rows = [(k, f"{prose(k, 30)}, {prose(k + 500, 15).upper()}! {prose(k + 50, 30)}") for k in range(6)] + ODD
    docs = frame(spark, rows)
    one = {r.doc_id: r for r in clean.find_overlap(docs.where("doc_id < 100"), bench).collect()}
    many = {r.doc_id: r for r in clean.find_overlap(docs.where("doc_id < 100"), bench, block_bytes=150).collect()}
    assert one == many and all(one[k].items == [str(k)] and one[k].spans == [30, 45] for k in range(6))
    out = {r.doc_id: r.text for r in clean.decontaminate(docs, bench).collect()}
    assert out[0].startswith(prose(0, 30)) and prose(500, 15).upper() not in out[0] and out[100] is None and out[103] == "é ß " * 5
    assert clean.find_overlap(docs, bench.where("false")).where("size(spans) > 0").count() == 0


def test_rows_stand_alone_whatever_the_blocks(spark):
    """Repeated and null ids, null items: the same rows come back with one block and with several."""
    items = [("i1", prose(1, 14, 9000)), (None, prose(2, 14, 9000)), ("i3", prose(3, 60, 9000)), ("i3", prose(4, 12, 9000)), ("i5", "two words"), ("i6", None), ("i7", " ... ")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    text = [f"{prose(50, 5)} {t} {prose(51, 5)}" for _, t in items if t and t.strip(" .")]
    rows = [(1, text[0]), (1, "a b c"), (None, text[1]), (None, f"{text[2]} {text[3]}"), (None, None), (7, " ".join(text)), (7, " ".join(text)), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda n: sorted(map(str, clean.find_overlap(docs, bench, block_bytes=n).collect()))
    one = by(8_000_000)
    assert by(120) == one and len(one) == len(rows)
    coded = [(i, [w.encode() for w in t.split()]) for i, t in items if t and t.strip(" .")]
    got = sorted(((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r.items) for r in clean.find_overlap(docs, bench).collect()), key=str)
    want = []
    for i, t in rows:
        words = [w.encode() for w in (t or "").split()]
        hit, _ = brute_hits(words, coded, 10)
        want.append((i, len(words), len(hit), sorted({k for k, w in coded if k and brute_hits(words, [(k, w)], 10)[0]})))
    assert got == sorted(want, key=str)


def test_long_items_keep_their_windows():
    words = prose(3, 500).encode().split()
    pieces = [p.split() for p in clean.item_pieces(b" ".join(words), 10, 400)]
    assert len(pieces) > 1
    assert {tuple(p[k : k + 10]) for p in pieces for k in range(len(p) - 9)} == {tuple(words[k : k + 10]) for k in range(len(words) - 9)}


# ---- HTML ----


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<style>x</style><script>'</p>'</script><b hidden>no</b>yes<i style='display:none'>no</i>", "yes"),
        ("<pre> a\n  b</pre>c &amp; d", " a\n  b\n\nc & d"),
        ("<div>one</div>two<br>three <b>four</b>", "one\ntwo\nthree four"),
        ("a < b <", "a < b <"),
        ("<b>" * 5000 + "deep", "deep"),
        ("<p class=it's>Hello</p><p>world</p> it's fine", "Hello\n\nworld\n\nit's fine"),
        ("<a title='x>y' data-q=\"<p>\">z</a", "z"),
        ("<table><tr>loose<td>a</table>", "loose\na"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>", "yes"),
        ("<div style='display:none'>no<b style='visibility: visible'>no</b></div>yes", "yes"),
        ("<dialog open>x</dialog><dialog>y</dialog><math><mi>z</mi></math>", "x\nz"),
        ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>bb<td>d</table>", "wide   c\na  bb  d"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<table><tr><td><table><tr><td>in<td>side</table><td>next</table>", "in  side\n\nnext"),
        ("<head><title>t</title><p>body text", "body text"),
        ("<svg><title/><text>s</text></svg> after", "s after"),
        ("<pre>\na\n\nb\n</pre>z", "a\n\nb\n\nz"),
        ("x<!-- <b> -->y</>c</ q>d<?php x?>e", "xycde"),
        ("a<!-->b", "ab"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ],
)
def test_rendering(source, want):
    assert html_text.extract_text(source) == want


@pytest.mark.parametrize(
    ("source", "n_words"),
    [
        ("<table><tr><td>x " * 5000, 5000),
        ("<div>" * 200_000 + "deep", 1),
        ("</b>" * 200_000 + "end", 1),
        ("<p>some text " * 150_000, 300_000),
        ("<ul><li>x " * 20_000, 40_000),
        ("<a x='>" * 200_000, 0),
        ("<" * 1_000_000, 1),
        ("<table>" + "<tr><td rowspan=9>a<td colspan=3>b" * 20_000, 40_000),
    ],
    ids=range(8),
)
def test_hard_pages_end_soon(source, n_words):
    import time

    began = time.perf_counter()
    assert len(html_text.extract_text(source).split()) == n_words
    assert time.perf_counter() - began < 30


def random_page(rng, depth):
    """(source, events) of a random piece: events are words, ("line", blank) and ("rows", lines)."""
    word = lambda: rng.choice(["alpha", "beta", "it's", "x&amp;y", "<!-- c -->gamma", "<b>bold</b>", "<i title=it's>odd</i>", "<span hidden>no</span>delta"])
    seen = {"x&amp;y": "x&y", "<!-- c -->gamma": "gamma", "<b>bold</b>": "bold", "<i title=it's>odd</i>": "odd", "<span hidden>no</span>delta": "delta"}

    def words(n):
        got = [word() for _ in range(n)]
        return " ".join(got), [seen.get(w, w) for w in got]

    def block(d, nested):
        kind = rng.choice(["p", "div", "text", "list", "table", "gone", "h2"] if d else ["p", "text"])
        close = lambda tag: rng.choice([f"</{tag}>", f"</{tag.upper()} >"])
        if kind in ("p", "h2"):
            text, got = words(rng.randrange(1, 4))
            end = "" if kind == "p" and rng.random() < 0.5 else close(kind)
            # an open paragraph goes on into text that follows, so an end tag of a block closes it here
            return f"<{kind}>{text}{end}" + ("<div></div>" if not end else ""), [("line", not nested), *got, ("line", not nested)]
        if kind == "text":
            text, got = words(rng.randrange(1, 4))
            return f" {text} ", got
        if kind == "gone":
            return "<div style='x:y; display : none'><p>no</div>", []
        if kind == "div":
            parts = [block(d - 1, nested) for _ in range(rng.randrange(1, 4))]
            return "<div class=a>" + "".join(s for s, _ in parts) + close("div"), [("line", False), *(e for _, x in parts for e in x), ("line", False)]
        if kind == "list":
            tag, out, events = rng.choice(["ul", "ol"]), "", [("line", not nested)]
            for k in range(rng.randrange(1, 4)):
                text, got = words(rng.randrange(1, 3))
                out += f"<li>{text}" + rng.choice(["", "</li>"])
                events += [("line", False), "-" if tag == "ul" else f"{k + 1}.", *got, ("line", False)]
            return f"<{tag}>{out}{close(tag)}" if not nested else "", events + [("line", not nested)] if not nested else []
        rows, out = [], ""
        for _ in range(rng.randrange(1, 4)):
            out, row = out + "<tr>", []
            for _ in range(rng.randrange(1, 4)):
                text, got = words(rng.randrange(1, 3))
                out += f"<td>{text}" + rng.choice(["", "</td>"])
                row.append(" ".join(got))
            rows.append(row)
            out += rng.choice(["", "</tr>"])
        wide = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
        return f"<table>{out}</table>", [("line", True), ("rows", ["  ".join(c.ljust(w) for c, w in zip(r, wide, strict=False)).rstrip() for r in rows]), ("line", True)]

    parts = [block(depth, False) for _ in range(rng.randrange(1, 5))]
    return "".join(s for s, _ in parts), [e for _, x in parts for e in x]


def test_random_pages_by_brute_force():
    rng = random.Random(12)
    for _ in range(600):
        source, events = random_page(rng, 3)
        lines, now, gap = [], [], False
        for e in [*events, ("line", False)]:
            if isinstance(e, str):
                now.append(e)
                continue
            kind, value = e
            for row in value if kind == "rows" else [" ".join(now)] if now else []:
                if gap and lines:
                    lines.append("")
                gap = False
                lines.append(row)
            now, gap = [], gap or value is True
        assert html_text.extract_text(source) == "\n".join(lines), source


# ---- suffix dedup ----


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data, gone = (t or "").encode(), set()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone.update(range(p, p + length))
            seen.add(s)
        spans = sum(p - 1 not in gone for p in gone)
        out[i] = (len(data), len(gone), spans, hashlib.sha256(bytes(b for k, b in enumerate(data) if k not in gone)).hexdigest())
    return out


def test_repeats_by_brute_force(spark):
    rng, passage = random.Random(8), prose(77, 60)
    rows = [(0, None), (1, ""), (2, "é" * 300), (3, passage), (4, passage)]
    for k in range(5, 40):
        cut = rng.randrange(0, 120)
        rows.append((k, prose(k, 20) + passage[cut : cut + rng.randrange(60, 250)] + prose(k + 900, 20) + (passage if k % 5 == 0 else "")))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows, 100)
    odd = suffix_dedup.remove_repeats(frame(spark, [(None, prose(1, 50)), (5, prose(1, 50)), (5, prose(1, 50))])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in odd) == [(False, len(prose(1, 50))), (False, len(prose(1, 50))), (True, 0)]
    assert suffix_dedup.remove_repeats(frame(spark, []).where("false")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame(spark, rows), length=200)


def test_loser_tree_merges():
    rng = random.Random(9)
    runs = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 20))) for _ in range(7)]

    def run(keys, n):
        shared, tails = suffix_dedup.front_code(keys)
        return ((s, k, (n, j)) for j, (s, k) in enumerate(suffix_dedup.front_decode(shared, tails)))

    got = list(suffix_dedup.LoserTree([run(r, n) for n, r in enumerate(runs)]))
    assert [k for _, k, _ in got] == sorted(k for r in runs for k in r)
    before = b""
    for shared, key, _ in got:
        assert shared == suffix_dedup.common_prefix(before, key, 0)
        before = key

"""Each operator against brute force on small tables that hold the odd cases: nulls, empty and long texts, ties,
repeated rows, clashing column names and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractwise.llm import chat, decontaminate, lines, mixing, neardup, passages, perplexity, quality, repeats, warc

WORDS = "the of and to in sun tree river stone cloud apple window garden letter music winter summer bridge forest engine".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, d int, th int, n double, `rows` string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) if rng.random() < 0.6 else rng.choice(WORDS[:5]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    out = [base, base, base.replace("the", "a", 1), None, "", "  \n ", "one", "two words", "One", "a b c d", "A  b\tc d"]
    out += [prose(rng, rng.randrange(5, 90)) for _ in range(20)]
    near = base.split()
    for i in range(8):
        copy = list(near)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = f"edit{i}"
        out.append(" ".join(copy) + ".\n" + prose(rng, 12))
    out += ["x" * 700, "ab" * 400, "é€😀 " * 90, base.upper(), prose(rng, 4_000), "l1\nl1\nl2 with a word\n\n" * 3]
    return out


@pytest.fixture(scope="module")
def rows(texts):
    docs = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "ß"][i % 4]) for i, t in enumerate(texts)]
    docs += [docs[0], docs[2], (None, texts[0], "en", "a"), (None, None, None, None)]
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "k", 2, 3, 0.5, "r") for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_quality_counts(docs, rows, empty):
    got = Counter(tuple(r)[:7] for r in quality.quality_rules(docs).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        w = split(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        held = [x for x in (text or "").split("\n") if split(x)]
        want[(doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(held) - len(set(held)), len(covered),
              len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert got == want
    assert quality.quality_rules(empty).count() == 0


def test_quality_verdict(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(rng.choice(WORDS) for _ in range(200)) + ".", "en") for i in range(40)]
    junk = [(100 + i, " ".join("$%#*" + str(rng.randrange(9)) for _ in range(200)), "en") for i in range(3)]
    upper = [(200, " ".join(rng.choice(WORDS) for _ in range(200)).upper(), "en")]
    short = [(300, " ".join("$%" for _ in range(20)), "xx")]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(clean + junk + upper + short, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i, *_ in clean)
    assert not any(out[i].kept for i in (100, 101, 102, 200, 300))
    assert out[300].class_distance is None  # guard


def classes_by_force(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = list(ids)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if root(a) != root(b) and linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, texts, empty, k):
    sets = {}
    for i, t in enumerate(texts):
        w = lowered(t).split(" ") and split(lowered(t))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    want = classes_by_force(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    out = neardup.near_duplicates(docs, k=k).collect()
    assert len(out) == len(texts) + 4
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(want)
    assert neardup.near_duplicates(empty).count() == 0


def test_signature_keys_meet_within_the_distance():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 32, neardup.POSITIONS)
        b = a.copy()
        b[rng.choice(neardup.POSITIONS, neardup.MAX_DIFFER, replace=False)] += 1
        x, y = neardup.keys_of(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n, letters="abé😀"):
    for _ in range(n):
        i, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:i] + (rng.choice(letters) if kind < 2 else "") + text[i + (kind > 0):]
    return text


def test_edit_distance_and_probes():
    rng = random.Random(3)
    for _ in range(1_500):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(7, 40)))
        b = changed(rng, a, rng.randrange(5))
        d = distance(a, b)
        for k in (1, 2, 3):
            assert lines.within(a, b, k) == (d <= k)
            if d <= k and min(len(a), len(b)) > 2 * k:
                keys, sketch = lines.keys_of([a, "zzzzzzzz", b], k)
                assert set(keys[0][keys[0] != 0].tolist()) & set(keys[2][keys[2] != 0].tolist())
                assert bin(int(sketch[0]) ^ int(sketch[2])).count("1") <= 4 * k


def test_line_dedup(spark, empty):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + "z" for _ in range(6)]
    docs = [(i, "\n".join(rng.choice([changed(rng, rng.choice(base), rng.randrange(3)), "".join(rng.choice("abcdefgh") for _ in range(50)),
                                      "short", "", "  "]) for _ in range(rng.randrange(6)))) for i in range(100)]
    docs += [(None, docs[5][1]), docs[7], (300, None), (301, "y" * 20_000), (302, "y" * 19_999 + "x")]
    first = {}
    for d, t in docs:
        for no, line in enumerate((t or "").split("\n")):
            if split(line):
                place = (-1 if d is None else d, no)
                first[line] = min(first.get(line, place), place)
    names = sorted(first, key=first.get)
    number = {line: i for i, line in enumerate(names)}

    def linked(a, b):
        a, b = names[a], names[b]
        if min(len(a), len(b)) < lines.MIN_CHARS or abs(len(a) - len(b)) > 2:
            return False
        return len(a) > 1_000 or distance(a, b) <= 2
    group = classes_by_force(range(len(names)), linked)
    want = Counter()
    for d, t in docs:
        held = (t or "").split("\n")
        kept = [x for no, x in enumerate(held) if not split(x) or first[names[group[number[x]]]] == (-1 if d is None else d, no)]
        want[(d, "\n".join(kept), len(held), len(held) - len(kept))] += 1
    table = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, th int, gone int, id string").repartition(4)
    out = lines.without_lines(table)
    assert out.columns == ["doc_id", "text", "th", "gone", "id", "line_dedup"]
    assert Counter((r.doc_id, r.text, *r.line_dedup) for r in out.collect()) == want
    assert lines.without_lines(empty).count() == 0


@pytest.mark.parametrize("hot", [1_024, 1])
def test_repeated_bytes(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    first = {}
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - 99):
            place = (-1 if doc_id is None else doc_id, i)
            first[b[i:i + 100]] = min(first.get(b[i:i + 100], place), place)
    want = Counter()
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i:i + 100]] != (-1 if doc_id is None else doc_id, i):
                gone[i:i + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in repeats.without_repeats(docs).collect()) == want
    if hot == 1:
        out = repeats.without_repeats(docs, spans=True).first()
        assert len(out.kept) == out.n_bytes - out.n_removed == out.n_bytes - sum(s.end - s.start for s in out.removed)
        assert repeats.without_repeats(empty).count() == 0


def test_repeated_passages(spark, docs, rows, empty):
    rng = random.Random(8)
    def passage(n):
        return ". ".join(" ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(9)) for _ in range(n)) + "."
    shared = passage(6)
    table = [(i, passage(5) + " " + (shared if i % 3 == 0 else passage(6)) + "\n" + passage(4)) for i in range(30)]
    out = {r.doc_id: r for r in passages.without_passages(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    for i, text in table:
        if i % 3 or i == 0:
            assert out[i].n_removed == 0 and out[i].kept_text == text
        else:
            assert out[i].n_removed >= 30 * 5 and out[i].class_doc_ids == [0] and len(out[i].kept_text.encode()) == out[i].n_bytes - out[i].n_removed
    odd = passages.without_passages(docs).collect()
    assert Counter(r.doc_id for r in odd) == Counter(r[0] for r in rows)
    by_id = {r.doc_id: r for r in odd}
    assert by_id[0].n_removed > 0 and by_id[0].class_doc_ids == [None]  # the row without an id stands first
    assert passages.without_passages(empty).count() == 0


def test_paragraphs_cover_unmarked_texts_and_passages_inside_sentences(spark):
    rng = random.Random(21)

    def unmarked(n, stops=0.0):
        return [f"w{rng.randrange(5_000)}" + ("." if rng.random() < stops else "") for _ in range(n)]

    def held(words):
        raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        _, _, s, e, _, _ = passages.paragraphs(raw, np.array([0, len(raw)]))
        return list(zip(s.tolist(), e.tolist()))
    for n in range(55, 85):
        for stops in (0.0, 0.02, 0.15):
            shared, spans = unmarked(n, stops), []
            for _ in range(2):
                before, after = unmarked(rng.randrange(200), stops), unmarked(rng.randrange(200), stops)
                whole = before + shared + after
                found = held(whole)
                assert {i for a, b in found for i in range(a, b)} == set(range(len(whole)))
                assert all(passages.MIN_WORDS <= b - a <= passages.MAX_WORDS for a, b in found)
                spans.append({(a - len(before), b - len(before)) for a, b in found if a >= len(before) and b <= len(before) + n})
            assert spans[0] & spans[1]
    shared = unmarked(80)
    table = [(i, " ".join(unmarked(150 + i) + shared + unmarked(90))) for i in range(6)] + [(9, " ".join(unmarked(300)))]
    out = {r.doc_id: r for r in passages.without_passages(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    for i, text in table:
        if i in (0, 9):
            assert out[i].kept_text == text
        else:
            lost = len(split(text)) - len(split(out[i].kept_text))
            assert out[i].class_doc_ids == [0] and 30 <= lost <= 100


def test_bands_miss_few_pairs_at_the_similarity():
    assert (1 - (passages.PERCENT / 100) ** passages.ROWS) ** passages.BANDS < 0.003


def test_decontamination(spark, empty):
    rng = random.Random(9)
    items = [(i, prose(rng, 30) + ". " + prose(rng, 6) + ".") for i in range(6)] + [(6, None), (None, "..."), (8, prose(rng, 150))]
    table = [(i, prose(rng, 150)) for i in range(20)]
    for i in range(6):
        body, answer = items[i][1].split(". ")[0].split(), items[i][1].split(". ")[1]
        weak = [w if j % 5 else f"new{j}" for j, w in enumerate(body)]
        table.append((100 + i, prose(rng, 70) + " " + items[i][1] + prose(rng, 70)))
        table.append((200 + i, prose(rng, 70) + "\n" + " ".join(weak[:28]).upper() + ", " + answer + " " + prose(rng, 20)))
    table += [(300, "start " + items[8][1]), (301, None), (302, ""), (None, items[0][1]), (100, table[20][1])]
    docs = spark.createDataFrame([(*r, 5, "q") for r in table], "doc_id long, text string, no int, dims string").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, no int")
    out = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert out == {(100 + i, i) for i in range(6)} | {(200 + i, i) for i in range(6)} | {(300, 8), (None, 0)}
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_items_that_the_basis_holds_poorly_are_found(spark, monkeypatch):
    rng, basis = random.Random(31), decontaminate.latent_basis
    monkeypatch.setattr(decontaminate, "latent_basis", lambda *a: (lambda used, rows: (used, 0 * rows))(*basis(*a)))

    def mixed(n):
        return [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(rng.sample(mixed(6) + [f"own{i}x{j}" for j in range(9)], 15))) for i in range(100)]
    table = []
    for i in range(0, 100, 4):
        table.append((i, " ".join([*mixed(rng.randrange(80, 120)), items[i][1], *mixed(rng.randrange(80, 120))])))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    out = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    missed = {(i, i) for i, _ in table} - set(out)
    assert not missed, f"{len(missed)} of {len(table)}"
    texts = {"i": dict(items), "d": dict(table)}
    for (d, i), r in out.items():
        assert r.lcs_words <= decontaminate.common_words(texts["i"][i].split(), texts["d"][d].split())
        assert r.lcs_words >= 0.75 * 15 or r.answer_found and r.lcs_words >= 7.5


def test_windows_are_met_by_their_share_of_a_passage():
    rng = np.random.default_rng(3)
    idf = rng.random(decontaminate.DIMS) + 0.1
    parts = [np.unique(rng.integers(0, 400, 30)) for _ in range(50)]
    dims = rng.integers(0, 400, 700)
    bounds = np.array([0, 10, 200, 264, 700])
    low, own, first, spans = [], [], [], []
    for i in range(4):
        blocks = list(range(bounds[i], bounds[i + 1], 32))
        for j in range(max(1, len(blocks) - 1)):
            first.append(len(low) + j)
            spans.append((blocks[j], min(blocks[j] + 64, bounds[i + 1])))
        low += blocks
        own += [i] * len(blocks)
    low, own = np.array(low), np.array(own)
    high = np.minimum(low + 32, bounds[1:][own])
    got = set(decontaminate._held(np.array(first), own, low, high, dims, decontaminate._postings(parts, idf), len(parts)))
    want = {(w, p) for w, (a, b) in enumerate(spans) for p, d in enumerate(parts)
            if (idf[np.intersect1d(d, dims[a:b])] ** 2).sum() >= decontaminate.MIN_SHARE * (idf[d] ** 2).sum()}
    assert want and want <= got


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.common_words(a, b) == row[-1]


def test_basis_spans_the_passages(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    dims = [sorted(set(rng.integers(0, 5_000, 20).tolist())) for _ in range(40)]
    idf = rng.random(decontaminate.DIMS) + 0.5
    used, basis = decontaminate.latent_basis(spark.createDataFrame([(d,) for d in dims], "dims array<long>"), idf, rank=40)
    place = {d: i for i, d in enumerate(used)}
    full = np.zeros((40, len(used)))
    for i, d in enumerate(dims):
        full[i, [place[x] for x in d]] = idf[d]
    folded = full @ basis
    assert np.allclose(folded @ folded.T, full @ full.T, atol=1e-3)


def test_perplexity(spark, empty):
    rng = random.Random(12)
    clean = [(i, "en", " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(120)]
    junk = [(500 + i, "en", " ".join(f"{rng.random():.9f}" for _ in range(60))) for i in range(5)]
    odd = [(900, "en", None), (901, "en", ""), (902, "en", "one two"), (903, "zz", " ".join(WORDS * 3)), (904, None, " ".join(WORDS * 2)), (None, "en", clean[0][2])]
    table = spark.createDataFrame([(*r, 1.0) for r in clean + junk + odd], "doc_id long, lang string, text string, n double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(904, 1, 0), (None, 1, 0), (501, 0, 0)], "doc_id long, quality long, toxic long")
    runs = [{r.doc_id: r for r in perplexity.quality_by_perplexity(table, labels, size=30, model_rows=m).collect()} for m in (1_000, 0)]
    out = runs[0]
    assert all(out[i].kept for i, *_ in clean) and not any(out[500 + i].kept for i in range(5))
    assert not out[900].kept and not out[901].kept and out[902].kept and out[903].kept and out[903].perplexity is None and out[904].kept
    for i in out:  # model handed to tasks, and model joined by key
        assert out[i].kept == runs[1][i].kept
        assert out[i].perplexity is None or abs(out[i].perplexity - runs[1][i].perplexity) < 1e-3 * out[i].perplexity
    assert perplexity.quality_by_perplexity(empty, labels).count() == 0
    assert perplexity.quality_by_perplexity(table, labels.limit(0)).where("not kept").count() == 2


def test_perplexity_is_a_distribution(spark):
    import numpy as np
    rng = random.Random(13)
    table = spark.createDataFrame([(i, "en", " ".join(rng.choice(WORDS[:8]) for _ in range(40))) for i in range(60)], "doc_id long, lang string, text string")
    model = perplexity.train(table, {"en": 0}, size=20)
    delta = {r.code: r.delta for r in model["deltas"].collect()}
    for a in range(2, 10):
        total = sum(np.exp(model["backoff"][0][a] + model["level"][0][b] + delta.get((a << perplexity._BITS) | b, 0.0)) for b in range(2, 10))
        assert 0.9 < total <= 1.0001


def test_vocabulary_keeps_thousands_of_words(spark):
    table = spark.createDataFrame([(i, "en", " ".join(f"w{j}" for j in range(50 * i, 50 * i + 80))) for i in range(100)], "doc_id long, lang string, text string")
    assert len(perplexity.train(table, {"en": 0})["vocabulary"][0]) == 5_030


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "\\", "### User: x </turn>\n### Assistant: y", "a\\\\b ### c </turn>\n", "é😀\n", "<\\/turn> ##### \\#"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant"], texts))]
    turns += [(2, 0, "user", "q"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "tool: x\n### \\", texts[4]), (3, 1, None, texts[7]),
              (None, None, "user", "n"), (None, 1, "assistant", texts[5]), (4, 1, "user", "t"), (4, 1, "assistant", "s"), (4, 1, "assistant", "s"), (5, 0, "user", texts[6])]
    table = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn int, role string, text string, segments int").repartition(3)
    out = {r.conv_id: r for r in chat.digests(chat.segments(table)).collect()}
    valid = {r.conv_id: r.valid for r in chat.turn_order(table).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        told = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert out[conv].n_turns == len(own)
        assert out[conv].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert valid == {1: True, 2: False, 3: False, None: True, 4: False, 5: False}
    assert chat.digests(chat.segments(table.limit(0))).count() == 0 and chat.turn_order(table.limit(0)).count() == 0


def test_fit_against_all_subsets():
    rng = random.Random(6)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 30), 4))
        counts = [rng.randrange(1, 4) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = rng.randrange(total + 1)
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(n * t for n, t in zip(lengths, take))
        assert got in sums and abs(budget - got) == min(abs(budget - x) for x in sums)


def test_mixing(spark, docs, rows, empty):
    out = mixing.mix(docs, carry=["text"]).collect()
    again = mixing.mix(docs.repartition(3), carry=["text"]).collect()
    assert Counter((r.doc_id, r.taken) for r in out) == Counter((r.doc_id, r.taken) for r in again)
    size = {None: 0}
    for _, text, _, source in rows:
        size[source] = size.get(source, 0) + len(split(text))
    goal = goals(size)
    taken = Counter()
    for r in out:
        assert r.size == len(split(r.text)) and r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert len(out) == len(rows)
    for source, g in goal.items():
        sizes = [len(split(text)) for _, text, _, s in rows if s == source]
        assert abs(taken[source] - round(g)) == abs(nearest(sizes, round(g)) - round(g))
    assert mixing.mix(empty).count() == 0


def goals(size):
    """Words per source: shares by weight, cut at twice the source, the rest dealt again."""
    names = sorted([s for s in size if s is not None]) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, left, free = {}, 1.5 * sum(size.values()), list(names)
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2 * size[s]
            left -= goal[s]
            free.remove(s)
    return goal | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


def nearest(sizes, goal):
    """The sum of whole documents, each taken 0, 1 or 2 times as the goal demands, that comes nearest; the smaller of two."""
    base = goal // sum(sizes) if sum(sizes) else 0
    sums = 1
    for n in sizes:
        sums |= sums << n
    reach = [i + base * sum(sizes) for i in range(sums.bit_length()) if sums >> i & 1]
    return min(reach, key=lambda x: (abs(x - goal), x))


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", "", None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é😀\r\n\r\n", "x" * 100_000, "<p>a</p>"]
    pages = [(i, f"http://x/{i}?a=%\r\nb", h) for i, h in enumerate(html)] + [(None, None, "<p>a</p>"), (None, "u", "only"), (7, "http://x/again", "<p>a</p>")]
    table = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    import base64
    got = Counter(tuple(r)[:5] for r in warc.round_trip(table).collect())
    top = {}
    for p, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if p is None else p)
    want = Counter()
    for p, _, h in pages:
        b = (h or "").encode()
        first = top[h or ""]
        response = first < 0 or p == first
        want[(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else first)] += 1
    assert got == want
    path = str(tmp_path / "warc")
    warc.write_warc(table, path, min_bytes=1)
    back = warc.read_warc(spark, path)
    assert back.where("record_type = 'revisit'").count() == 3  # pages 0, 1 and the one without an id; empty payloads stay responses
    assert back.where(F.col("page_id").isin(4, 5)).select("payload").count() == 2
    assert {bytes(r.payload).decode() for r in back.where(F.col("page_id").isin(4, 5)).collect()} == {html[4], html[5]}
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.round_trip(table.limit(0)).count() == 0

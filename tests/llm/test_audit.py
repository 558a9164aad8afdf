"""The filter audit, subword tokens and importance resampling against plain versions on small tables with odd cases."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tractwise.llm import interaction, resampling, subwords

SCHEMA = "doc_id long, text string, lang string, id string, part int, mask int, hash string, n double, bits string, score string, n_words string, rank int"
WORDS = "the of and to in sun tree river stone cloud".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) if rng.random() < 0.6 else rng.choice(WORDS[:3]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    long = prose(rng, 30_000)
    texts = [prose(rng, 250), "same text " * 120, "same text " * 120, None, "", "  \n ", "ONE TWO", "a|b $5 " * 60, prose(rng, 210).upper(), long, long,
             "é€漢🤖 Ünïcode" * 3, "a\x00b", "x" * 5_000, " " * 4_000 + "y", "A Á É", "nul\tl\x0bf\x0c"] + [prose(rng, rng.randrange(1, 400)) for _ in range(40)]
    out = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    return out + [out[1], out[0], (None, texts[1], "en"), (None, None, None), (3, "same text " * 120, "fr")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, 2, "h", 0.5, "b", "s", "w", 3) for r in rows], SCHEMA).repartition(7).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ the audit
def test_filter_audit(spark, rows, docs, empty):
    marks = [(0, 1, 0), (1, 1, 0), (1, 0, 1), (2, 0, 1), (9, None, None), (None, 1, 1), (10, 1, None), (7, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, text string")
    good, toxic = {d for d, q, _ in marks if q == 1 and d is not None}, {d for d, _, t in marks if t == 1 and d is not None}
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    failed = []
    for d, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > first[text]}
        failed.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    want = {}
    for part in {f[0] for f in failed}:
        mine, shapley = [f for f in failed if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order):
                out, keep = [f for f in left if x in f[1]], [f for f in left if x not in f[1]]
                fails = sum(x in f[1] for f in mine)
                want[part, "".join(order), step + 1] = [len(keep), len(out), fails - len(out), sum(f[1] == {x} for f in mine),
                                                        sum(f[2] for f in out), sum(f[3] for f in out)]
                shapley[x] += len(out)
                left = keep
        for (p, order, step), v in want.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in interaction.audit(docs, labels).collect()}
    assert got == want and len(got) == 600 * len({f[0] for f in failed})
    assert interaction.audit(empty, labels).count() == 0
    assert interaction.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# ------------------------------------------------------------------ subwords
@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_subwords_equal_the_library(rows, docs, empty, model, library):
    got = Counter(tuple(r) for r in subwords.digests(docs, model).collect())
    want = Counter()
    for d, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    encoded = subwords.encode(docs, model)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter(
        (d, tuple(library.encode(t or "", add_bos=True, add_eos=True))) for d, t, _ in rows)
    assert Counter((r.doc_id, r.text) for r in subwords.decode(encoded, model).collect()) == Counter((d, t or "") for d, t, _ in rows)
    assert subwords.digests(empty, model).count() == subwords.encode(empty, model).count() == subwords.decode(encoded.limit(0), model).count() == 0


def test_decoding_of_any_ids(spark, model, library):
    rng = random.Random(2)
    lists = [[], [1], [2], [3 + 0xE2, 3 + 0x82], [259], [28705, 264], [1, 28705, 28705, 2], [0], [264, 0, 0, 264], [3 + 0xFF, 264], [3 + 0xED, 3 + 0xA0, 3 + 0x80]]
    lists += [[rng.randrange(32_000) if rng.random() < 0.7 else rng.randrange(3, 259) for _ in range(rng.randrange(20))] for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(lists)), "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in subwords.decode(table, model).collect()} == {i: library.decode(x) for i, x in enumerate(lists)}


@pytest.mark.parametrize("limit", [8, 64, 1 << 22])
def test_merge_rounds(model, library, limit, monkeypatch):
    """Runs that stop rounds, ties, pieces of the vocabulary side by side, blocks cut between words, and the queue of long words."""
    rng, vocab = random.Random(limit), subwords.vocabulary(open(model, "rb").read())
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    kinds = ["abcdefgh thein  ", "▁ \n\tab", "é漢字🤖한국어 ab", "=-_*#/. ", "the in er on  "]
    texts = ["".join(rng.choice(k) for _ in range(rng.randrange(70))) for k in kinds for _ in range(60)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", " " * 3_000, "ab" * 2_000, "=" * 3_000]
    for long_word in (1_024, 4):
        monkeypatch.setattr(subwords, "LONG_WORD", long_word)
        ids = [[] for _ in texts]
        for parts in subwords.blocks(pa.array(texts, pa.string()), limit):
            flat, edge = subwords.encoded(vocab, parts)
            for k, part in enumerate(parts):
                ids[part[0]] += flat[edge[k]:edge[k + 1]].tolist()
        assert ids == [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]


# ---------------------------------------------------------------- resampling
@pytest.mark.parametrize("n,share,least", [(1, 10, 20), (2, 50, 1), (3, 100, 0)])
def test_resampling(spark, rows, docs, empty, n, share, least):
    wanted = [prose(random.Random(9), 60), None, "", "The Sun, the TREE"]
    target = spark.createDataFrame([(t, 1) for t in wanted], "text string, bucket int")

    def grams(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(w), [crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(grams(text)[1])
    for text in wanted:
        t.update(grams(text)[1])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    out = []
    for d, text, _ in rows:
        words, found = grams(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, -x[1], -x[2]))
    drawn = order[:len(order) * share // 100]
    want = Counter((*x[:4], i + 1) for i, x in enumerate(drawn)) + Counter((*x[:4], None) for x in order[len(drawn):]) + Counter((*x[:4], None) for x in out if not x[4])
    got = resampling.resample(docs, target, n=n, share=share, min_words=least)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert resampling.resample(empty, target, n=n).count() == 0
    assert resampling.resample(docs, target.limit(0), n=n, share=share, min_words=least).count() == len(rows)

"""Perplexities against a plain interpolated modified Kneser-Ney bigram model that counts in dictionaries."""

import math
import random
import re
from collections import Counter

import pytest

from tractwise.llm import perplexity


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts):
    """log P(word | before) of the model of these texts; None stands before the first word."""
    pairs = Counter((a, b) for t in texts for a, b in zip([None, *split(t)], split(t)))
    of = [sum(n == i for n in pairs.values()) for i in range(5)]
    y = of[1] / max(1, of[1] + 2 * of[2])
    d = [0.0] + [min(0.95 * i, max(0.1, i - (i + 1) * y * of[i + 1] / max(1, of[i]))) for i in (1, 2, 3)]
    total, cut, follow = Counter(), Counter(), Counter(b for _, b in pairs)
    for (a, _), n in pairs.items():
        total[a] += n
        cut[a] += d[min(n, 3)]
    kinds, words = len(pairs), len(follow)

    def log_p(a, b):
        low = (follow[b] - 0.5 + 0.5 * words / (words + 1)) / kinds if b in follow else 0.5 / (kinds + 1)
        if a not in total:
            return math.log(low)
        n = pairs.get((a, b), 0)
        return math.log((n - d[min(n, 3)] if n else 0.0) / total[a] + cut[a] / total[a] * low)

    return log_p


@pytest.mark.parametrize("model_rows", [1_000_000, 0])
def test_perplexity_equals_plain_model(spark, model_rows):
    rng = random.Random(11)
    words = "the of and to in sun tree river stone cloud apple".split()
    texts = [" ".join(rng.choice(words[: 4 + i % 8]) + (str(rng.randrange(6)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(1, 80))) for i in range(120)]
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)]
    rows += [(200, "The  OF\tnever seen words here " * 5, "en"), (201, None, "en"), (202, texts[1], "en"), (1, texts[1], "en"), (None, texts[2], "en"), (203, "word " * 3_000, "en"), (204, texts[4], "xx")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, cost string, n int").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 100)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(100) if i % 2 == 0}
    models = {lang: plain([t for d, t, x in rows if d in trusted and x == lang]) for lang in ("en", None)}
    want = Counter()
    for d, t, lang in rows:
        w = split(t)
        cost = -sum(models[lang](a, b) for a, b in zip([None, *w], w)) / len(w) if w and lang in models else None
        want[d, lang, len(w), None if cost is None else round(cost, 4)] += 1
    got = perplexity.quality_by_perplexity(docs, labels, size=500, model_rows=model_rows).collect()
    assert Counter((r.doc_id, r.lang, r.n_words, None if r.perplexity is None else round(math.log(r.perplexity), 4)) for r in got) == want
    for r in got:
        judged = r.n_words >= perplexity.MIN_WORDS and r.perplexity is not None and r.threshold is not None
        assert r.kept == (r.perplexity <= r.threshold if judged else r.n_words > 0)


@pytest.mark.parametrize("model_rows", [1_000_000, 40, 0])
def test_words_without_a_number_keep_their_own_counts(spark, model_rows):
    """With three numbered words a language, all others and their bigrams still count one by one."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(words[int(40 * rng.random() ** 2)] for _ in range(rng.randrange(5, 60))) for _ in range(90)]
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)] + [(200, "unseen words only " * 9, "en"), (201, "word1 " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    models = {lang: plain([t for d, t, x in rows if d < 90 and d % 2 == 0 and x == lang]) for lang in ("en", None)}
    got = {r.doc_id: math.log(r.perplexity) for r in perplexity.quality_by_perplexity(docs, labels, size=3, model_rows=model_rows).collect()}
    assert len(got) == len(rows)
    for d, t, lang in rows:
        w = split(t)
        assert abs(got[d] + sum(models[lang](a, b) for a, b in zip([None, *w], w)) / len(w)) < 1e-4

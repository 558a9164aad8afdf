"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text, per language.

All trusted text is counted; counts, continuation counts and context totals are tables keyed by n-gram and are joined
as such. Every word of trusted text is a word of the model: the VOCAB most frequent of each language are numbered, any
other goes by a hash. The model is additive: a document's log-probability is the sum of back-off weight and continuation
probability over its words, plus a correction for every bigram that was seen. Weights of numbered words are arrays; what
else the model holds is keyed by a code, of which the MODEL_ROWS most frequent at most are handed to the tasks. Codes of a
document that are not among them are joined to the rest by key. Hashes have 61 bits and are taken to be equal only for equals.

A document is kept unless its log-perplexity lies above the upper fence of its language, upper quartile plus FENCE
times the spread between quartiles, taken over the documents that were not trained on.

Defined results. Null or empty text: no words, no perplexity, not kept. Fewer than MIN_WORDS words, or a language
without trusted text: not judged, kept. Null lang: a language of its own. Null doc_id: not trusted, scored all the same.
Repeated rows: each for itself. Empty table: no rows. Only doc_id, lang and text (doc_id, quality) are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .common import dropped, small, stored, text_batches

VOCAB = 8_192              # words a language that go by a number; others go by a hash
MODEL_ROWS = 4_000_000     # codes of 12 bytes that may be handed to every task; others are joined
IDS_BOUND = 500_000
SHARDS = 16                # parts in which the model is fetched
MIN_WORDS = 20
FENCE = 3.0
_BITS = 20                 # of a word number in a bigram's code
_UNK, _START = 0, 1        # word numbers; words of the vocabulary follow
_AFTER = 2
_CONTEXT, _LEVEL = 1, 2    # added to a hashed word: codes of its back-off weight and of its continuation


def _hashed(x):
    """A negative number whose last two bits are free."""
    return ((x | np.uint64(1 << 63)) & ~np.uint64(3)).view(np.int64)


def _pairs(lang, a, b):
    """Codes of bigrams: both numbers where both words have one, else a hash; hashed words name their language."""
    mixed = arrays.mixed(a.view(np.uint64) * np.uint64(arrays._P) + arrays.mixed(b.view(np.uint64)))
    return np.where((a < 0) | (b < 0), _hashed(mixed), (lang << 2 * _BITS) | (a << _BITS) | b)


def _coded(batch, names, vocabulary):
    """Per chunk of a batch (lang, text at columns 1, 2): text numbers, languages, previous and current words, sizes.

    A word is its number or, where it has none, a negative hash; the first word of a text follows _START.
    """
    codes, numbers = vocabulary
    langs = np.array([names.get(x, -1) for x in batch.column(1).to_pylist()], dtype=np.int64)
    for low, high, data, offsets in arrays.chunks(batch, 2):
        hashes, bounds, _ = arrays.words_of(data, offsets, lower=True)
        owner = np.repeat(np.arange(high - low), np.diff(bounds))
        lang = langs[low:high][owner]
        key = arrays.mixed(hashes + lang.astype(np.uint64) * np.uint64(arrays._P))
        at = np.minimum(np.searchsorted(codes, key), max(0, len(codes) - 1))
        word = np.where(codes[at] == key, numbers[at], _hashed(key)) if len(codes) else _hashed(key)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[bounds[:-1][np.diff(bounds) > 0]] = _START
        yield low, high, owner, lang, before, word, np.diff(bounds)


def _vocabulary(trusted, names, size):
    """lang (number), code, m (frequency rank from 0) of the `size` most frequent words of each language."""
    def count(batches):
        for batch in batches:
            langs = np.array([names.get(x, -1) for x in batch.column(1).to_pylist()], dtype=np.int64)
            for low, high, data, offsets in arrays.chunks(batch, 2):
                hashes, bounds, _ = arrays.words_of(data, offsets, lower=True)
                lang = np.repeat(langs[low:high], np.diff(bounds))
                key = arrays.mixed(hashes + lang.astype(np.uint64) * np.uint64(arrays._P))
                found, first, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang[first], pa.int64()), pa.array(found.view(np.int64), pa.int64()), pa.array(n, pa.int64())],
                                                 names=["lang", "code", "n"])
    counts = stored(trusted.mapInArrow(count, "lang long, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "words")
    part = counts.withColumn("salt", F.pmod("code", F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), "code")
        part = part.withColumn("m", F.row_number().over(order)).where(F.col("m") <= size)
    return part.select("lang", "code", F.col("m") - 1), counts


def train(trusted: DataFrame, names: dict, size: int = VOCAB):
    """The model of trusted text (doc_id, lang, text): vocabulary, back-off and continuation tables, bigram corrections."""
    kept, counts = _vocabulary(trusted, names, size)
    kept = kept.toPandas()                                   # at most `size` words a language
    dropped(counts)
    codes = kept["code"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(codes)
    vocabulary = (codes[order], kept.iloc[:, 2].to_numpy(dtype=np.int64)[order] + _AFTER)

    def count(batches):
        for batch in batches:
            for _, _, _, lang, before, word, _ in _coded(batch, names, vocabulary):
                code, first, n = np.unique(_pairs(lang, before, word), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code, lang[first], before[first], word[first], n)], names=["code", "lang", "a", "b", "n"])

    bigrams = stored(trusted.mapInArrow(count, "code long, lang long, a long, b long, n long").groupBy("code").agg(
        F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n").alias("n")), "bigrams")

    # discounts of each language from its counts of counts
    d = bigrams.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.lit(1)).alias("kinds"),
                                    F.countDistinct("b").alias("words"))
    y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))
    def discount(i):
        raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.lit(1.0), F.col(f"n{i}"))
        return F.least(F.lit(0.95 * i), F.greatest(F.lit(0.1), raw)).alias(f"d{i}")
    d = stored(d.select("lang", "kinds", "words", *[discount(i) for i in (1, 2, 3)]), "discounts")

    contexts = bigrams.groupBy("lang", "a").agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("k1"), F.count_if(F.col("n") == 2).alias("k2"), F.count_if(F.col("n") > 2).alias("k3"))
    contexts = stored(contexts.join(small(d), "lang").select(
        "lang", "a", "total", ((F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")).alias("gamma")), "contexts")
    # continuation probability, mixed with the uniform one so that no word of the vocabulary is impossible
    follow = bigrams.groupBy("lang", "b").agg(F.count(F.lit(1)).alias("k"))
    follow = stored(follow.join(small(d), "lang").select(
        "lang", "b", "k", ((F.col("k") - 0.5 + 0.5 * F.col("words") / (F.col("words") + 1)) / F.col("kinds")).alias("p")), "continuations")
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    seen = bigrams.join(contexts, ["lang", "a"]).join(follow, ["lang", "b"]).join(small(d), "lang")
    low = F.col("gamma") * F.col("p")
    deltas = seen.select("code", F.log(((F.col("n") - cut) / F.col("total") + low) / low).alias("delta"), "n")
    # hashed words have their weights beside the corrections; a continuation counts from that of an unknown word
    weights = contexts.where("a < 0").select(F.col("a").bitwiseOR(F.lit(_CONTEXT)).alias("code"), F.log("gamma").alias("delta"), F.col("total").alias("n"))
    unknown = F.log(0.5 / (F.col("kinds") + 1))
    levels = follow.where("b < 0").join(small(d), "lang").select(
        F.col("b").bitwiseOR(F.lit(_LEVEL)).alias("code"), (F.log("p") - unknown).alias("delta"), F.col("k").alias("n"))
    deltas = stored(deltas.unionByName(weights).unionByName(levels), "corrections")
    dropped(bigrams)

    rows = {x: size + _AFTER for x in names.values()}
    backoff = {x: np.zeros(n) for x, n in rows.items()}      # an unseen context backs off whole
    level = {x: np.full(n, np.nan) for x, n in rows.items()}
    for r in contexts.where("a >= 0").select("lang", "a", F.log("gamma").alias("v")).toLocalIterator():
        backoff[r["lang"]][r["a"]] = r["v"]
    for r in follow.where("b >= 0").select("lang", "b", F.log("p").alias("v")).toLocalIterator():
        level[r["lang"]][r["b"]] = r["v"]
    for x, kinds in ((r["lang"], r["kinds"]) for r in d.collect()):
        level[x] = np.where(np.isnan(level[x]), np.log(0.5 / (kinds + 1)), level[x])
    return {"names": names, "vocabulary": vocabulary, "backoff": backoff, "level": level, "deltas": deltas, "size": size}


def score(docs: DataFrame, model: dict, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Append n_words and log_p (null where the language has no model) to docs (row, lang, text); text is dropped."""
    names, vocabulary, size = model["names"], model["vocabulary"], model["size"] + _AFTER
    tables = [np.concatenate([model[k][x] for x in range(len(names))]) if names else np.zeros(0) for k in ("backoff", "level")]
    # the most frequent codes are handed to the tasks, as many as are allowed; where others are left, they are joined
    times = Window.orderBy(F.desc("n"))                      # one row per small count, and one for all others
    bins = model["deltas"].groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    bins = bins.withColumn("rows", F.sum("rows").over(times)).collect()
    least = min((r["n"] for r in bins if r["rows"] <= model_rows), default=None)
    whole = not bins or max(r["rows"] for r in bins) <= model_rows
    parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))]
    for shard in range(SHARDS if least is not None else 0):
        part = model["deltas"].where(F.col("n") >= least).where(F.pmod(F.xxhash64("code"), F.lit(SHARDS)) == shard).select("code", F.col("delta").cast("float")).toPandas()
        parts.append((part["code"].to_numpy(dtype=np.int64), part["delta"].to_numpy(dtype=np.float32)))
    code, delta = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code)
    shared = docs.sparkSession.sparkContext.broadcast((names, vocabulary, tables, code[order], delta[order]))

    def run(batches):
        names, vocabulary, (backoff, level), held, delta = shared.value
        for batch in batches:
            for low, high, owner, lang, before, word, size_of in _coded(batch, names, vocabulary):
                known = lang >= 0
                owner, lang, before, word = (x[known] for x in (owner, lang, before, word))
                at = lang * size
                value = backoff[at + np.maximum(before, _UNK)] + level[at + np.maximum(word, _UNK)] if len(backoff) else np.zeros(len(word))
                total = np.bincount(owner, weights=value, minlength=high - low)
                rare, later = word < 0, before < 0
                codes = np.concatenate([_pairs(lang, before, word), before[later] | _CONTEXT, word[rare] | _LEVEL])
                whose = np.concatenate([owner, owner[later], owner[rare]])
                found = np.zeros(len(codes), dtype=bool)
                if len(held):
                    i = np.minimum(np.searchsorted(held, codes), len(held) - 1)
                    found = held[i] == codes
                    total += np.bincount(whose[found], weights=delta[i[found]], minlength=high - low)
                judged = np.array([names.get(x, -1) >= 0 for x in batch.column(1).slice(low, high - low).to_pylist()], dtype=bool)
                columns = [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(size_of, pa.int64()),
                           pa.array(total, mask=~judged)]
                if not whole:
                    codes, whose = codes[~found], whose[~found]
                    edge = np.r_[0, np.cumsum(np.bincount(whose, minlength=high - low))]
                    columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(codes[np.argsort(whose, kind="stable")])))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "lang", "n_words", "log_p", "codes"][:len(columns)])

    schema = f"row {docs.schema['row'].dataType.simpleString()}, lang string, n_words long, log_p double"
    if whole:
        return docs.select("row", "lang", "text").mapInArrow(run, schema)
    rows = stored(docs.select("row", "lang", "text").mapInArrow(run, schema + ", codes array<long>").withColumn(
        "at", F.monotonically_increasing_id()), "scores")
    rest = model["deltas"] if least is None else model["deltas"].where(F.col("n") < least)
    seen = rows.select("at", F.explode("codes").alias("code"))
    more = seen.join(rest.select("code", "delta"), "code").groupBy("at").agg(F.sum("delta").alias("more"))
    return rows.drop("codes").join(more, "at", "left").withColumn("log_p", F.col("log_p") + F.coalesce("more", F.lit(0.0))).drop("at", "more")


def quality_by_perplexity(docs: DataFrame, labels: DataFrame, size: int = VOCAB, model_rows: int = MODEL_ROWS,
                          min_words: int = MIN_WORDS, fence: float = FENCE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold (of the language) and kept; trusted text has quality 1 in labels."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = small(stored(ids, "trusted"), IDS_BOUND)
    trusted = docs.join(ids, "doc_id", "left_semi")
    names = {r[0]: i for i, r in enumerate(sorted(trusted.select("lang").distinct().collect(), key=lambda r: (r[0] is None, r[0] or "")))}
    model = train(trusted, names, size)
    rows = docs.select(F.struct("doc_id").alias("row"), "lang", "text")
    scored = stored(score(rows, model, model_rows).select(
        "row.doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, -F.col("log_p") / F.col("n_words")).alias("cost")), "perplexities")
    judged = scored.where((F.col("n_words") >= min_words) & F.col("cost").isNotNull())
    marked = judged.join(ids.withColumn("used", F.lit(True)), "doc_id", "left")
    unused = F.col("used").isNull()
    quartiles = marked.groupBy("lang").agg(
        F.percentile_approx(F.when(unused, F.col("cost")), [0.25, 0.75], 10_000).alias("own"),
        F.percentile_approx("cost", [0.25, 0.75], 10_000).alias("all"), F.count_if(unused).alias("n"))
    q = F.when(F.col("n") >= 20, F.col("own")).otherwise(F.col("all"))
    limits = quartiles.select(F.col("lang").alias("of"), q.alias("q")).select("of", (F.get("q", F.lit(1)) + fence * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))).alias("limit"))
    out = scored.join(small(stored(limits, "thresholds")), F.col("lang").eqNullSafe(F.col("of")), "left")
    short = (F.col("n_words") < min_words) | F.col("cost").isNull() | F.col("limit").isNull()
    kept = F.when(F.col("n_words") == 0, F.lit(False)).when(short, F.lit(True)).otherwise(F.col("cost") <= F.col("limit"))
    return out.select("doc_id", "lang", "n_words", F.exp("cost").alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))

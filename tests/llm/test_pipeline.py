"""The pipeline against a plain version of its stages on a small table."""

import random

import pytest

import corpus_pipeline
from test_operators import goals, nearest
from tractwise.llm import lines

WORDS = "the of and to in was for that with this".split()


def test_stages(spark, tmp_path):
    rng = random.Random(1)

    def prose(n):
        return " ".join(rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice("abcdefghiklmnoprst") for _ in range(7)) for _ in range(n))

    item = prose(40) + "."
    docs = [(i, prose(70) + ".\n" + prose(70) + ".", "en", f"s{i % 3}") for i in range(60)]
    docs += [(100, " ".join("$%&" for _ in range(80)), "en", "s0"),          # rejected by the base rules
             (101, docs[0][1], "en", "s1"),                                  # loses all its lines
             (102, docs[1][1].split("\n")[0] + "\n" + prose(90), "en", "s1"),  # loses one line
             (103, prose(60) + " " + item + " " + prose(30), "en", "s2")]    # holds a benchmark item
    near = docs[2][1].replace("\n", " ").split()
    near[10], near[70] = "changedword", "otherword"
    docs += [(104, " ".join(near), "en", "s0"), (105, None, None, None)]     # near copy in one line; null text
    folder = str(tmp_path)
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    at, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        seen.append({r.doc_id: r for r in at.collect()})
        if name != "mixing":
            assert at.columns == corpus_pipeline.COLUMNS
    every = {d[0] for d in docs}
    assert set(seen[0]) == every - {100, 105}
    assert set(seen[1]) == every - {100, 105, 101}
    assert seen[1][102].text == docs[62][1].split("\n")[1] and seen[1][102].n_chars == len(seen[1][102].text)
    assert all(seen[1][d[0]].text == d[1] for d in docs if d[0] < 60)
    assert set(seen[2]) == every - {100, 105, 101, 104}
    assert set(seen[3]) == every - {100, 105, 101, 104, 103}
    taken = seen[4]
    assert set(taken) <= set(seen[3])
    sizes = {}
    for r in seen[3].values():
        sizes.setdefault(r.source, []).append(len(r.text.split()))
    for source, goal in goals({s: sum(n) for s, n in sizes.items()}).items():
        got = sum(r.taken for r in taken.values() if r.source == source)
        assert abs(got - round(goal)) == abs(nearest(sizes[source], round(goal)) - round(goal))
    out = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, folder).collect()}
    assert out == {k: r.taken for k, r in taken.items()}


def test_empty(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_short_lines_need_whole_segments(spark):
    with pytest.raises(ValueError):
        lines.removed_lines(spark.createDataFrame([], "d long, th int, text string"), min_chars=3)

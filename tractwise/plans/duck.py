"""SQL fragments for the oracle side, written independently of the Spark expressions."""


def count(x, letter):
    return f"(length({x}) - length(replace({x}, '{letter}', '')))"


def clean(x):
    return f"regexp_replace(replace(upper({x}), 'U', 'T'), '[^ACGT]', 'N', 'g')"


def revcomp(x):
    return f"reverse(translate({x}, 'ACGTUacgtuNn', 'TGCAAtgcaaNn'))"


def runs(x):
    return f"regexp_extract_all({x}, 'G+|C+|[^GC]+')"


def hunter_sum(x):
    return (f"list_sum(list_transform({runs(x)}, lambda r: CASE WHEN r[1] = 'G' THEN least(length(r), 4) * length(r) "
            f"WHEN r[1] = 'C' THEN -least(length(r), 4) * length(r) ELSE 0 END))")


def hunter_mean(x):
    return f"(cast({hunter_sum(x)} AS double) / length({x}))"


def scores(x):
    return (f"flatten(list_transform({runs(x)}, lambda r: list_transform(range(length(r)), lambda i: "
            f"CASE WHEN r[1] = 'G' THEN least(length(r), 4) WHEN r[1] = 'C' THEN -least(length(r), 4) ELSE 0 END)))")


def scored(view, x):
    """The view with its per-base scores in sc_, which window_means reads."""
    return f"(SELECT *, {scores(x)} AS sc_ FROM {view}) AS {view}"


def window_means(x, w=25):
    v = f"least({w}, length({x}))"
    return (f"list_transform(range(1, length({x}) - {v} + 2), lambda i: "
            f"cast(list_sum(list_slice(sc_, i, i + {v} - 1)) AS double) / {v})")


def tract(base, tract="{3}", loop=7, letter="[ACGT]"):
    return (f"{base}{tract}" + f"{letter}{{1,{loop}}}{base}{tract}" * 3)


PAT = {"G4": tract("G", loop=7), "iM": tract("C", loop=12)}
SPAN = {"G4": 33, "iM": 48}


def mcount(x, kind):
    return f"cast(len(regexp_extract_all({x}, '{PAT[kind]}')) AS bigint)"


def longest(x, base):
    return f"coalesce(list_max(list_transform(regexp_extract_all({x}, '{base}+'), lambda r: length(r))), 0)"

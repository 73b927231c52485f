"""Odd rows that every operator has to take, and small brute-force parts."""

import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def odd_documents(spark, docs):
    """Null ids, texts and sources, empty and very long texts, repeated rows and ids, and columns whose names clash."""
    rows = [
        (None, "a row without an id", "en", "src0", 1), (None, None, None, None, None), (5, "dup id", "en", "src0", 1), (5, "dup id", "en", "src0", 1),
        (2000, None, "en", None, 1), (2001, "", "en", "src1", 0), (2002, " \n ", "en", "src1", 3), (2003, "One two", "en", "src1", 7), (2004, "one TWO", "en", "src1", 7),
        (2005, "word " * 30_000, "en", "src1", 150_000), (2006, "x" * 100_000, "en", "src1", 1), (2007, "é€𝒳 tab\tand space  two <|endoftext|> MIT License", "en", "src1", 1),
    ]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def clashing(docs):
    """Further columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in ("score", "predicted", "n", "ref", "shard", "key", "copies", "repetition", "rate", "bucket", "pos", "shuffle_key")})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def groups(rows):
    """(doc_id, text) -> sorted (doc_id, size, smallest id reachable), by comparing all pairs that share a shingle."""
    import collections

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    where = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is None or not sets[i]:
            continue
        shared = collections.Counter(j for h in sets[i] for j in where[h])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for h in sets[i]:
            where[h].append(i)
    members = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    return sorted(((rows[i][0], len(sets[i]), None if rows[i][0] is None else min(members[find(i)])) for i in range(len(rows))), key=str)

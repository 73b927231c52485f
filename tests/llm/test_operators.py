import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from nearfold.llm import components, ego, extract, fingerprint, hosts, licenses, mixing, packing, textvec, tjoin, tokenfile, tokens, toxicity
from nearfold.llm.oracles import OP2, OP4, OP9, OP10
from nearfold.llm.queries import QUERIES

from .helpers import SF, UP, clashing, groups, odd_documents


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").cache()


@pytest.fixture(scope="module")
def odd(spark, docs):
    return clashing(odd_documents(spark, docs)).cache()


@pytest.mark.parametrize("name,sql", [("op2_host_reputation", OP2), ("op4_poisson_mix", OP4), ("op9_epsilon_grid", OP9), ("op10_t_occurrence", OP10)])
def test_equal_to_sql(name, sql, same):
    same(QUERIES[name], sql)


def collected(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1


def test_fingerprint(odd):
    for df in (odd, odd.limit(1), odd.limit(0)):
        rows = sorted(collected(df), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1].encode()))
        want = []
        for i, (d, t) in enumerate(rows):
            n, half = rows[(i + 1) % len(rows)][1], len(t) // 2
            want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
        got = fingerprint.fingerprint(df).collect()
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        if len(got) > 100:
            assert np.median([r["near_edited"] for r in got]) > 0.4 > 0.1 > np.median([r["near_next"] for r in got])


def test_fingerprints_are_homomorphic():
    of = lambda t: fingerprint.encode(*fingerprint.vectors([t]))[0]
    assert of("a b\nc d\n\ne") == of("e\na b\nc d") != of("a b\nc d") and of("a a") != of("a")
    assert fingerprint.combine(of("a b"), of("c d")) == of("c d\na b")
    assert fingerprint.combine(of("a b\nc d\nc d"), of("c d"), delete=True) == of("a b\nc d")
    assert of(None) == of("") == of(" \n") and of("a\na") != of("a")
    assert fingerprint.likeness(fingerprint.vectors(["", "x y"]), fingerprint.vectors(["", "x y"])).tolist() == [1.0, 1.0]


# 2


def test_urls(spark):
    urls = ["http://WWW.Example.ORG/es/x?q", "https://a.b.com/fr/", "http://x.de", None, "no scheme", "ftp://h:80#f", "http://example.org/en/1", "http://notexample.org/es/", "http://a.com/de/1", "http://1.2.3.4/x", "http:///p", "http://a.co.uk/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, "http://x.org/")], "page_id long, url string").selectExpr("*", "'clash' AS host", "1 AS n")
    outcomes = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, None), (None, 1)], "page_id long, good int")
    got = {r["page_id"]: r for r in hosts.judge(pages, outcomes).collect()}
    assert hosts.judge(pages, outcomes).count() == 14
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(9)] == [
        ("www.example.org", "/es/x", "example.org/es/"), ("a.b.com", "/fr/", "com/fr/"), ("x.de", "", None), ("", "", None), ("", "", None),
        ("h:80", "", None), ("example.org", "/en/1", "example.org/en/1"), ("notexample.org", "/es/", "org/"), ("a.com", "/de/1", "com/de/"),
    ]
    assert [got[i]["verdict"] for i in (0, 1, 6, 7, 8)] == ["block", "allow", "block", "allow", "block"]
    assert hosts.judge(pages.limit(0), outcomes).count() == 0 and hosts.judge(pages, outcomes.limit(0)).count() == 14
    d, s = hosts.domain_and_suffix(pages["url"])
    parts = {r["h"]: (r["d"], r["s"]) for r in spark.createDataFrame([("a.b.co.uk",), ("b.org",), ("1.2.3.4",), ("com",), ("",)], "url string").selectExpr("url").select("url", hosts.domain_and_suffix(hosts.F.col("url"))[0].alias("d"), hosts.domain_and_suffix(hosts.F.col("url"))[1].alias("s")).withColumnRenamed("url", "h").collect()}
    assert parts == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.org": ("b.org", "org"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "com": ("com", "com"), "": ("", "")} and d is not None and s is not None


def test_shrinkage(spark):
    """A host with few labels stays near its domain; one with many bad pages falls below the bound."""
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.example.com/{i}") for i in range(400)] + [(1000, "http://new.example.com/"), (1001, "http://new.other.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "page_id long, good int")
    got = {r["host"]: r["verdict"] for r in hosts.judge(pages, outcomes, rules=[]).collect()}
    assert got["good.example.com"] == "allow" and got["bad.example.com"] == "block"


# 3


def test_packing(odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    for df in (odd, odd.limit(2), odd.limit(0)):
        want = collections.defaultdict(list)
        for d, t in collected(df):
            want[d].append(np.array(whole.encode(t, add_special_tokens=False).ids + [1], "<u4"))
        got, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.pack(df).collect():
            got[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert set(got) == set(want)
        for d, texts in want.items():
            assert sum(map(len, texts)) == sum(r["length"] for r in got[d])
            if len(texts) == 1:
                at = 0
                for r in sorted(got[d], key=lambda r: r["start"]):
                    assert r["start"] == at and r["doc_tokens"] == len(texts[0])
                    at += r["length"]
                    assert r["ids_crc32"] == zlib.crc32(texts[0][r["start"] : at].tobytes())
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at and length > 0
                at += length
            assert at <= 2048 and (at & (at - 1)) == 0  # no sequence needs padding


def test_neighbours_are_those_of_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 40, rng.integers(5, 40)).astype("<u2") for _ in range(30)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=40)
    idf, mean = np.log1p((30 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    shard = packing.Shard(docs, idf, mean, 1000)
    unused = np.ones(30, bool)
    unused[[0, 3]] = False
    score = [sum(idf[t] * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in np.unique(docs[0]) if (c := (d == t).sum())) for d in docs]
    want = sorted((i for i in range(30) if unused[i]), key=lambda i: (-round(score[i], 9), i))
    assert list(shard.neighbours(0, unused)) == want


def test_packing_by_whole_documents_and_content(spark):
    rng = np.random.default_rng(3)
    long = " alpha" * 3000 + " omega" * 500
    texts = [long, " omega short"] + [" ".join(f"topic{t}" for _ in range(20)) + " " + " ".join(map(str, rng.integers(0, 9, 10))) for t in range(20) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = tokens.vocabulary("byte_bpe_50k.json")
    stored = packing.tokenized(docs, vocab, 1, 2048)
    terms, frequency, mean, n = packing.statistics(stored, "<u2")
    ids = [np.array(tokens.encoder(vocab).encode([t])[0]) for t in texts]
    want = collections.Counter(t for x in ids for t in set(x.tolist()) | {1})
    assert dict(zip(terms.tolist(), frequency.tolist())) == want and n == len(texts) and abs(mean - np.mean([len(x) + 1 for x in ids])) < 1e-9
    together = collections.defaultdict(set)
    for r in packing.pack(docs, shard_docs=8).where("doc_id > 1").collect():
        together[r["sequence_id"] >> 40].add((r["doc_id"] - 2) // 4)
    assert sum(map(len, together.values())) <= 20 + 2 * len(together)  # a topic's documents are in one partition, but for its borders


# 4


def test_mixing(odd, spark):
    out = mixing.replicate(odd, alpha=0.5, factor=2.0)
    rows = out.collect()
    assert all(1 <= r["repetition"] <= r["copies"] for r in rows) and [r["shuffle_key"] for r in rows] == sorted(r["shuffle_key"] for r in rows)
    rates = {r["source"]: r for r in mixing.rates(odd, alpha=0.5, factor=2.0).collect()}
    total = sum(r["chars"] for r in rates.values())
    assert abs(sum(r["rate"] * r["chars"] for r in rates.values()) - 2 * total) < 1e-6 * total
    table = mixing.poisson_table(1.3)
    assert abs(table[2] - np.exp(-1.3) * (1 + 1.3 + 1.3**2 / 2)) < 1e-12
    many = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text", "if(id % 4 = 0, 'a', 'b') AS source")
    counts = {r["source"]: r["n"] for r in mixing.replicate(many, {"a": 3.0, "b": 1.0}).groupBy("source").agg(mixing.F.count("*").alias("n")).collect()}
    assert abs(counts["a"] - 15_000) < 400 and abs(counts["b"] - 5_000) < 250
    assert mixing.replicate(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(many, {"a": 1.0, "b": 0.0}, factor=40.0)


def test_mixing_takes_any_rate_and_any_number_of_sources(spark):
    small = spark.range(3).selectExpr("id AS doc_id", "'x' AS text", "'small' AS source")
    large = spark.range(20).selectExpr("id + 10 AS doc_id", "repeat('word ', 400000) AS text", "'large' AS source")
    df = small.union(large)
    rate = {r["source"]: r["rate"] for r in mixing.rates(df).collect()}["small"]
    copies = [r["copies"] for r in mixing.replicate(df).where("source = 'small' AND repetition = 1").collect()]
    assert rate > 50 and len(copies) == 3 and all(abs(c - rate) < 6 * rate**0.5 for c in copies)
    mean = 160.0
    numbers = np.array([0.001, 0.25, 0.5, 0.9, 0.99999])
    table = np.array(mixing.poisson_table(mean, 1e-9))
    assert mixing.counts(np.full(5, mean), numbers).tolist() == np.searchsorted(table, numbers, "right").tolist()
    assert abs(mixing.counts(np.array([1e9]), np.array([0.5]))[0] - 1e9) <= 2
    many = spark.range(100_500).selectExpr("id AS doc_id", "'xy' AS text", "if(id % 3 = 0, null, concat('s', id)) AS source")
    drawn = mixing.replicate(many).groupBy("doc_id").count().count()
    want = sum(r["n_docs"] * (1 - np.exp(-r["rate"])) for r in mixing.rates(many).collect())
    assert abs(drawn - want) < 700
    two = mixing.replicate(spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string"), factor=200_000.0)
    assert two.count() == two.selectExpr("max(repetition)").first()[0] == two.selectExpr("max(copies)").first()[0] > 190_000


# 5

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_license(text, rules):
    """Base places, and the labels of the detections that no other contains, by comparing all pairs."""
    w = WORDS.findall(text.translate(UP))
    places, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split(" ")
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    joined, found = " " + " ".join(w) + " ", []
    if re.search(licenses.GATE.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), text):
        for label, priority, key, pattern in rules:
            if key in joined:
                found += [(m.start(), -m.end(), -priority, label) for m in re.finditer(rf"(?<= ){pattern}(?= )", joined)]
    found.sort()
    labels = {d[3] for i, d in enumerate(found) if not any(e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] for e in found[:i])}
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels))


LICENSED = [
    "MIT License MIT License", "Licensed under the Apache License, Version 2.0; see GNU General Public License v3.", "cc-by 4.0 and CC BY-SA 4.0 or Creative Commons Attribution 4.0",
    "SPDX-License-Identifier: GPL-2.0", "a mit licenses mitlicense apache-license", "GNU GENERAL PUBLIC LICENSE " * 50, "apache.org/licenses/LICENSE-2.0 All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "released into the public domain", "ccé by cc\nby",
]


def test_licenses(spark, odd):
    rules = licenses.rules()
    assert len(rules) >= 300
    more = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(LICENSED)], "doc_id long, text string")
    df = odd.select("doc_id", "text").union(more)
    got = collections.Counter(tuple(r)[:7] for r in licenses.scan(df).collect())
    want = collections.Counter((r["doc_id"], *brute_license(r["text"] or "", rules)) for r in df.collect())
    assert got == want
    assert all(0 <= r["score"] <= 1 for r in licenses.scan(df).collect()) and licenses.scan(df.limit(0)).count() == 0


def spelled(pattern):
    """Texts that a pattern of the rules matches: every branch, with and without what is optional."""
    import re._parser as parser

    def of(tree):
        texts = [""]
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "IN":
                more = ["x" if str(kind) == "RANGE" else chr(x) for kind, x in arg]
            elif op == "SUBPATTERN":
                more = of(arg[3])
            elif op == "BRANCH":
                more = [t for branch in arg[1] for t in of(branch)]
            else:
                assert op == "MAX_REPEAT"
                more = ([""] if arg[0] == 0 else []) + of(arg[2])
            texts = [a + b for a in texts for b in more]
        return texts

    return of(parser.parse(pattern))


REAL = {
    "CC0 1.0 Universal": "cc0-1.0", "Proprietary and confidential": "proprietary", "https://mozilla.org/MPL/2.0/": "mpl-2.0", "scripts.sil.org/OFL": "ofl", "www.eclipse.org/legal/epl-2.0": "epl-2.0",
    "Historical Permission Notice and Disclaimer": "hpnd", "All rights\nreserved": "all-rights-reserved", "dedicated to the public\n  domain": "public-domain", "CC BY-NC 4.0": "cc-by-nc-4.0",
    "CC BY Non Commercial": "cc-by-nc", "Do What The Fuck You Want To Public License": "wtfpl", "beer ware license": "beerware",
}


def test_no_match_is_gated(spark):
    for label, _, key, pattern in licenses.rules():
        for text in spelled(pattern):
            assert re.fullmatch(pattern, text) and key in f" {text} ", (label, key, text)
            raw = text.upper().replace(" ", ".\n")
            assert re.search(licenses.GATE, raw) and re.search(licenses.GATE, f"É-{raw}"), (label, text)
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(list(enumerate(REAL)), "doc_id long, text string")).collect()}
    assert [x in got[i] for i, x in enumerate(REAL.values())] == [True] * len(REAL)


# 6


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder(odd, file):
    from tokenizers import Tokenizer

    path = tokens.vocabulary(file)
    whole = Tokenizer.from_file(path)
    texts = [t for _, t in collected(odd)] + ["it's  ok\n x", "a \n b", " lead", "trail ", "don't DON'T 's 're", "ﬁ Å İstanbul ſ ẞ", "a b c　d", "🙂 🙂🙂", "1234 56-78", "¡hola! ¿qué?", "\x1c \x85 x", "é å"]
    texts += ["a.\nB\n\nc,\n d", "x" * 200 + " y" * 3, "a <|endoftext|> b.c", "don't-'s 'll(y)", "\u0130-x \u00e9,\u00fc;\u0416!", "\nA\n", "5%-(6)"]
    encoder = tokens.WordEncoder(path, words=2000)
    for i in range(0, len(texts), 40):  # the memory overflows on the way
        ids, offsets = encoder.encode(texts[i : i + 40])
        for k, t in enumerate(texts[i : i + 40]):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def test_word_encoder_on_random_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    kinds = {f: (tokens.WordEncoder(tokens.vocabulary(f)), Tokenizer.from_file(tokens.vocabulary(f))) for f in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    alphabet = st.one_of(st.sampled_from(" \n\t  abAB'.,-=<|1×İЖΣςＡéß́ "), st.characters(exclude_categories=["Cs"]))

    @settings(max_examples=600, deadline=None)
    @given(st.text(alphabet, max_size=40))
    def equal(text):
        for own, whole in kinds.values():
            assert own.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids

    equal()


def test_bit_planes(odd, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 65_536, n).astype(np.uint32)
        assert (tokenfile.unpack_planes(tokenfile.pack_planes(ids, 2), n) == ids).all()
        if n:
            first = np.unpackbits(np.frombuffer(tokenfile.pack_planes(ids, 2)[3], np.uint8), bitorder="little")[:n]
            assert (first == (ids >> 3 & 1)).all()
    with open(tmp_path / "f", "wb") as f:
        w = tokenfile.Writer(f, block=64, width=3)
        lens = np.array([0, 200, 1, 64])
        ids = rng.integers(0, 1 << 24, 265).astype(np.uint32)
        w.add([3, None, 5, 6], lens, ids)
        w.close()
    with open(tmp_path / "f", "rb") as f:
        r = tokenfile.Reader(f, (tmp_path / "f").stat().st_size)
        assert [x.tolist() for x in r.documents()] == [[], ids[:200].tolist(), ids[200:201].tolist(), ids[201:].tolist()] and r.known.tolist() == [True, False, True, True]
        assert (r.chunk(1) == ids[64:128]).all()
    raw = (tmp_path / "f").read_bytes()
    (tmp_path / "g").write_bytes(raw[:-30] + b"x" + raw[-29:])
    with open(tmp_path / "g", "rb") as f, pytest.raises(ValueError):
        tokenfile.Reader(f, len(raw))
    with pytest.raises(ValueError), open(tmp_path / "h", "wb") as f:
        w = tokenfile.Writer(f)
        w.add([1], np.array([1]), np.array([70_000], np.uint32))
        w.close()
    whole = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    for df in (odd, odd.limit(1), odd.limit(0)):
        want, at = [], 0
        for d, t in sorted(collected(df), key=lambda r: (r[0] if r[0] is not None else -(2**63), r[1].encode())):
            ids = whole.encode(t, add_special_tokens=False).ids + [2]
            want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(map(tuple, tokenfile.round_trip(df).collect()), key=lambda r: r[1]) == want


# 7


def test_toxicity(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sf = "/root/testdata/sf0.1"
    found = toxicity.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    held = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id) and ((held.score >= 0.7) == (held.predicted == 1)).all()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.predicted == 1).sum() >= 0.9 and hit / (held.toxic == 1).sum() >= 0.6
    twice = labels.union(labels.selectExpr("doc_id", "quality", "null")).selectExpr("*", "1 AS score")
    got = toxicity.classify(odd, twice)
    assert got.count() == odd.count() and got.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert toxicity.classify(odd, labels.limit(0)).select("score").distinct().count() == 1
    again = odd.selectExpr("doc_id", "text").union(spark.range(300).selectExpr("7 AS doc_id", "concat('copy ', id) AS text"))
    assert toxicity.train(again, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int")).bits == 18  # one row of each doc_id is learned from
    assert toxicity.classify(odd.limit(0), labels).count() == 0


def test_pairs_are_learned():
    """An insult is toxic only beside a mention: no additive weights tell these rows apart."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, (2, 2000))
    place = np.concatenate([np.r_[[1] * x, [2] * y, 3].astype(np.int32) for x, y in zip(a, b)])
    offsets = np.r_[0, np.cumsum(a + b + 1)]
    label = (a == b).astype(float)
    model = toxicity.fit(place, np.ones(len(place), np.float32), offsets, label, 4, epochs=60, decay=1e-5, least=1, seed=3)
    got = model.scores(place, np.ones(len(place), np.float32), offsets) > 0.5
    assert (got == (label == 1)).mean() > 0.95


# 8

ARTICLE = "<h1>Title &amp; more</h1><p>First&nbsp;long paragraph of the article, with <b>bold</b> words and a <a href=x>link</a> in it.</p><p>Short.<p>Third  \n paragraph is long too, and says one more thing about it.</p>"
TEXT = "Title & more\nFirst long paragraph of the article, with bold words and a link in it.\nShort.\nThird paragraph is long too, and says one more thing about it."
PAGES = [
    f"<html><head><title>t</title><script>if (a<b) x('</p>')</script><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>A</a></ul></nav><div class='ad'>Buy this now, it is a very good thing to buy indeed.</div><article>{ARTICLE}</article><footer>&copy; 2020 all the rights of everyone and more</footer>",
    f"<body><header><a href=/>Site</a></header><main>{ARTICLE}<aside>Aside text that is long enough to count for something.</aside><form><input><label>Your name</label></form></main><section id='comments'><p>I disagree with the article and say so at length here.</p></section></body>",
    f"<div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content>{ARTICLE}</div><div class='cookie-notice'>We use cookies on this site to make it better for you.</div><div class=sidebar><p>Related things to read that are also rather long.</p></div>",
    f"<article><div class='share'>Share</div>{ARTICLE}<!-- ad --><div style='display:none'>hidden words</div><div hidden>more hidden words</div><noscript>no script</noscript></article>",
]


@pytest.mark.parametrize("page", PAGES)
def test_extraction(page):
    assert extract.main_text(page) == TEXT


def test_words_that_an_article_may_use_and_forms_around_it():
    kept = "<section id=discussion><p>What was found is discussed.</p></section><section id=related-work><p>Others did it before.</p></section><div class=alert><p>Do back up first.</p></div>"
    page = f"<article>{ARTICLE}{kept}<div class='related-posts'><p>Another post</p></div><form><label>Your name</label></form></article>"
    assert extract.main_text(page) == TEXT + "\nWhat was found is discussed.\nOthers did it before.\nDo back up first."
    assert extract.main_text(f"<body><form id=aspnetForm><div class=menu><a href=1>One</a></div><main>{ARTICLE}</main></form></body>") == TEXT
    assert extract.main_text(f"<body><form><div class=menu><a href=1>One</a></div><div>{ARTICLE}</div></form><form><p>Search</p></form></body>") == TEXT


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "plain text\nonly"), (None, "u", "<p>" * 5000 + "deep text"), (5, "u", "<![if x]><p>a</p><![endif]><div"), (6, "u", "<nav>never closed<article>" + ARTICLE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = {r["page_id"]: r for r in extract.extract(df).collect()}
    assert extract.extract(df).count() == 7 and extract.extract(df.limit(0)).count() == 0
    assert (got[1]["text"], got[2]["text"], got[None]["text"], got[6]["text"]) == ("", "", "deep text", TEXT) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[3]["text"] == "plain text only"


# 9


def test_epsilon_grid(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] * rng.uniform(0.5, 2) + rng.normal(0, 0.12, 16)).tolist(), int(i % 3)) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 16, 1) for i in range(300)]
    rows += [(None, [1.0] * 16, 1), (3000, None, 1), (3001, [0.0] * 16, 1), (3002, [None] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [1.0] * 16, None), (3005, [2.0] * 16, 1), (3005, [2.0] * 16, 1), (3006, [1.0, 2.0], 1), (3007, [], 1), (3008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS id", "1 AS key")
    n, ok = len(rows), [i for i, (d, v, y) in enumerate(rows) if d is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = np.zeros(n, int), list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for kind in {(rows[i][2], len(rows[i][1])) for i in ok}:
        own = [i for i in ok if (rows[i][2], len(rows[i][1])) == kind]
        x = np.array([rows[i][1] for i in own], np.float32).astype(float)
        size = np.sqrt((x * x).sum(1))
        near = x @ x.T / np.outer(size, size) >= 0.93
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            links[own[a]] += 1
            p, q = find(own[a]), find(own[b])
            parent[max(p, q)] = min(p, q)
    least = collections.defaultdict(list)
    for i in range(n):
        least[find(i)].append(rows[i][0])
    want = sorted(((rows[i][0], int(links[i]), min(least[find(i)], default=None) if rows[i][0] is not None else None) for i in range(n)), key=str)
    assert 0 < links.sum()
    got = ego.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert ego.near_duplicates(df.limit(0)).count() == 0


def test_distant_blocks_are_skipped():
    a = ego.unit(np.random.default_rng(0).normal(size=(300, 8)).astype(np.float32).tobytes(), 8)
    x, y = ego.join_blocks(a, a, a, a, 0.93, True)
    near = np.triu(a @ a.T >= 0.93, 1)
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*map(list, np.nonzero(near))))


# 10


def test_join_equals_brute_force(spark, odd):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choice(words, 60))
    for g in range(6):  # groups of near copies that share a passage
        own = rng.choice(words, 150)
        for _ in range(40):
            t = own.copy()
            t[rng.integers(0, 150, rng.integers(0, 6))] = "edit%d" % rng.integers(1000)
            rows.append(" ".join(t) + (" " + passage if g % 2 else ""))
    rows += [passage] * 20 + [passage + " x"] * 5 + [" ".join(rng.choice(words, 50)) + " " + passage for _ in range(40)]
    made = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    df = odd.select("doc_id", "text", "ref", "n", "shard").unionByName(made.selectExpr("*", "'x' AS ref", "'x' AS n", "'x' AS shard"))
    for some in (df, odd.limit(0)):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in tjoin.join(some).collect()), key=str)
        assert got == groups([(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()])


@pytest.mark.parametrize("sets_most", [16, 2048])
def test_large_blocks_in_chunks(spark, sets_most, monkeypatch):
    monkeypatch.setattr(tjoin, "CHUNK_SETS", sets_most)
    rng = np.random.default_rng(5)
    own = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        t = list(own)
        for at in rng.integers(0, 100, rng.integers(0, 4)):
            t[at] = "e%d" % rng.integers(5)
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in tjoin.join(df).collect()), key=str)
    assert got == groups(list(enumerate(texts)))


def test_large_block_of_several_components(spark, monkeypatch):
    monkeypatch.setattr(tjoin, "CHUNK_SETS", 8)
    monkeypatch.setattr(tjoin, "PIVOTS", 2)
    rng = np.random.default_rng(8)
    passage, rows = [f"p{i}" for i in range(60)], []
    for g in range(12):  # groups that share a passage, too little to link them
        own = [f"g{g}w{i}" for i in range(60)]
        for _ in range(int(rng.integers(1, 12))):
            t = [*own, *passage]
            for at in rng.integers(0, 60, rng.integers(0, 5)):
                t[at] = "e%d" % rng.integers(10**6)
            rows.append((len(rows), " ".join(t)))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in tjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == groups(rows) and len({c for _, _, c in got}) > 12


def test_search_by_t_occurrence():
    rng = np.random.default_rng(6)
    for trial in range(20):
        sets = []
        for _ in range(60):
            if sets and rng.random() < 0.7:
                s = set(sets[rng.integers(len(sets))])
                for x in rng.choice(sorted(s), min(len(s), int(rng.integers(0, 5))), replace=False):
                    s.discard(x)
                s |= set(rng.integers(0, 500, rng.integers(0, 4)).tolist())
            else:
                s = set(rng.integers(0, 500, rng.integers(1, 40)).tolist())
            sets.append(s or {1})
        sizes = np.array([len(s) for s in sets])
        hashes = np.array([x for s in sets for x in sorted(s)], np.uint64)
        for side in (None, (np.arange(60) % 2).astype(np.int64)):
            forest = components.Forest(60)
            for i in range(60):
                for j in range(i):
                    if (side is None or side[i] != side[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        forest.union(i, j)
            assert tjoin.search(sizes, hashes, side).roots().tolist() == forest.roots().tolist()


def test_shingle_sets():
    import pyarrow as pa

    from nearfold.llm.common import strings

    from .helpers import shingles

    texts = ["a b c d e f", "A B c d e F", "", None, " \x0b\x0c", "one", "x y z w", "é É a b c\td\ne f g a b c d e"]
    hashes, offsets = textvec.shingle_sets(*strings(pa.array(texts)))
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]
    assert hashes[offsets[0] : offsets[1]].tolist() == hashes[offsets[1] : offsets[2]].tolist()


def test_components(spark, monkeypatch):
    import random

    monkeypatch.setattr(components, "BATCH", 40)
    rng, edges = random.Random(3), []
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(80)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 400)]
    want, parent = {}, {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

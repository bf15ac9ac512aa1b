"""Importance resampling, URL filters and cross-tokenizer alignment against brute force, and on hard rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from terralith.llm import alignment, importance, queries, url_rules

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "Long words, and more. " * 20_000
TEXTS = [None, "", " ", "Ünïcode and the ＦＵＬＬ width, CAPS", "one", "two words", "a b c d", LONG, "x" * 50_000, "sp▁ace", "tab\tline\nend\r\n", "<s> </s> <|endoftext|> <unk> <0x0A>", "日本語 text 𝔘\x00 e\u0301", *["the same text of more than twenty words " * 4] * 3]
SCHEMA = "doc_id long, text string, n_words int, tokens int, score int, block int, rank int, salt int, given int, Text_ int"


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, 1, 2, 3, 4, 5, 6, 7, 8) for i, t in enumerate(TEXTS)] + [(None, "of no id and", 0, 0, 0, 0, 0, 0, 0, 0), (2, "again the second", 0, 0, 0, 0, 0, 0, 0, 0), (2, "again the second", 0, 0, 0, 0, 0, 0, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampled(rows, target, least, percent):
    """By the letter of the definition, a run's string and CRC at a time."""
    counted = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in counted for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 1e4) / ((s[b] + 1.0) * (n_t + 1e4)))) for b in range(10_000)]
    out = []
    for i, n, f in counted:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is None, o[0] or 0, o[2]))
    most = percent * len(able) // 100
    ranks = [(tuple(o), k + 1 if k < most else None) for k, o in enumerate(able)] + [(tuple(o), None) for o in out if o[1] < least]
    return sorted(((*o, k) for o, k in ranks), key=repr)


@pytest.mark.parametrize(("least", "percent"), [(20, 5), (1, 60), (3, 100), (10_000_000, 5)])
def test_resampling_is_its_definition(spark, hard, least, percent):
    target = ["the words of the target", None, "", "Long words and more", "text of more than TWENTY"]
    got = importance.resample(hard, spark.createDataFrame([(t,) for t in target], "text string"), least_words=least, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled([(r.doc_id, r.text) for r in hard.collect()], target, least, percent)


def test_ranks_over_many_ranges_and_ties(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("doc_id"), F.lit("a b").alias("text"))
    ranked = importance.resample(rows, rows.limit(0), least_words=2, percent=40).collect()
    assert sorted(r["rank"] for r in ranked if r["rank"]) == list(range(1, 2_001))
    drawn, left = [r for r in ranked if r["rank"]], [r for r in ranked if not r["rank"]]
    assert min(r["score"] for r in drawn) >= max(r["score"] for r in left)
    order = sorted(drawn, key=lambda r: r["rank"])
    assert [r["score"] for r in order] == sorted((r["score"] for r in drawn), reverse=True)


def test_an_empty_corpus_and_an_empty_target(spark, hard):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).count() == 0
    assert importance.resample(hard, empty).count() == hard.count()


def test_crc_algebra():
    r = random.Random(5)
    for _ in range(300):
        a, b = (bytes(r.randrange(256) for _ in range(r.choice([0, 1, 2, 7, 300]))) for _ in "ab")
        one = importance.shifted(importance.shift_tables(len(b))[None], np.zeros(1, np.int64), np.array([zlib.crc32(a)], np.uint32))[0]
        assert int(one) ^ zlib.crc32(b) == zlib.crc32(a + b)
    texts = pa.array(["x", "Hello WORLD, foo-bar éa1", "", "no"] * 3).slice(1, 7)  # words never run on into the next text
    bounds, word, known = importance.words(texts)
    spelled = [known[w].decode() for w in word]
    assert [spelled[i:j] for i, j in itertools.pairwise(bounds)] == [WORD.findall(t.lower()) for t in texts.to_pylist()]


URLS = [None, "", "no scheme/at all", "http://", "HTTP://WWW.Example.COM/en/1", "https://example.com/en/", "https://notexample.com/en/", "http://a.example.com/en/x?y#z", "http://a.net/es/1", "http://net/fr/", "http://x.net:80/fr/", "http://b.org/fr/1?k=v&k=w&=e", "http://com", "http://com/", "http://Ünï.com/a/b", "://", "a://b://c/d", "http://q.net?u=http://x.com/", "http://spam-farm.org/en/" + "9" * 5_000, "http://t.com/" + "s/" * 3_000]


def judged(rows, labels=None, support=url_rules.MIN_SUPPORT, sure=url_rules.MIN_CONFIDENCE):
    """Given rules and every token combination counted one by one."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def cut(url):
        if url is None or "://" not in url:
            return "", "", []
        scheme, rest = url.split("://", 1)
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        query = re.match(r"[^?#]*(?:\?([^#]*))?", rest)[1] or ""
        host = host.translate(upper)
        found = [("scheme", scheme.translate(upper)), *(("host", x) for x in host.split(".") + re.split("[.-]", host)), *(("path", re.sub("[0-9]+", "#", x)) for x in path.split("/")), *(("query", x.split("=")[0]) for x in query.split("&"))]
        return host, path, sorted({f"{k} {v}" for k, v in found if v})

    def given(host, path):
        fit = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    known = [(i, *cut(u), *given(*cut(u)[:2])) for i, u in rows]
    taught = [(k[3], k[5]) for k in known if k[5]] if labels is None else [(cut(u)[2], x) for u, x in labels]
    n = Counter(x for _, x in taught)
    usual = "block" if n["block"] > n["allow"] else "allow"
    prior = n[usual] / len(taught) if taught else 1.0
    seen, both = Counter(), Counter()
    for tokens, label in taught:
        for k in (1, 2, 3):
            for some in itertools.combinations(tokens, k):
                seen[some] += 1
                both[some, label] += 1
    rules = {(p, x): c / seen[p] for (p, x), c in both.items() if c >= math.ceil(support * len(taught)) and c / seen[p] >= sure and (x != usual or c / seen[p] > prior)}
    rules = {(p, x): c for (p, x), c in rules.items() if not any(rules.get((q, x), 0) >= c for k in range(1, len(p)) for q in itertools.combinations(p, k))}
    out = []
    for i, host, path, tokens, rule, verdict in known:
        fit = sorted((-c, -both[p, x], x != "block", " + ".join(p), x) for (p, x), c in rules.items() if set(p) <= set(tokens)) if rule is None else []
        out.append((i, host, path, rule, verdict or (fit[0][4] if fit else usual), fit[0][3] if fit else None))
    return sorted(out, key=repr)


def test_url_filters_are_their_definition(spark):
    few = [u for u in URLS if u is None or len(u) < 100]
    rows = list(enumerate(few)) + [(None, "http://www.example.com/en/"), (3, "http://b.org/en/7"), (3, "http://b.org/en/7")]
    pages = spark.createDataFrame([(i, u, 1, 2, 3) for i, u in rows], "page_id long, url string, tokens int, Host int, given int").repartition(3)
    assert sorted((tuple(r) for r in url_rules.judge(pages).collect()), key=repr) == judged(rows)
    labels = [("http://ok.org/a", "allow")] * 5 + [("http://ok.org/b-c", "block"), ("http://b-c.net/x", "block"), ("http://b.org/en/1", "block")] * 2
    taught = spark.createDataFrame(labels, "url string, label string")
    assert sorted((tuple(r) for r in url_rules.judge(pages, labels=taught).collect()), key=repr) == judged(rows, labels)


def test_url_filters_on_long_urls_and_nothing(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert url_rules.judge(pages).count() == len(URLS)
    assert url_rules.judge(pages.limit(0)).count() == 0
    unlabelled = url_rules.judge(pages.filter("url like '%org%'")).collect()
    assert {r.verdict for r in unlabelled} == {"allow"} and {r.rule for r in unlabelled} == {None}


def aligned(rows):
    """Whole texts through the libraries, groups by walking along the bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    spelled = alignment.ByteLevel(A).bytes, alignment.Pieces(B).bytes
    made, count = [], Counter()
    for i, text in rows:
        sides = [a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)] if text else [[], []]
        if any(b"".join(s[t] for t in x) != (" " + text).encode() for s, x in zip(spelled, sides, strict=True) if text):
            sides = [[], []]
        ends = [list(itertools.accumulate(len(s[t]) for t in x)) for s, x in zip(spelled, sides, strict=True)]
        at, groups, links = [0, 0], [], []
        for cut in sorted(set(ends[0]) & set(ends[1])):
            part = []
            for k in (0, 1):
                to = ends[k].index(cut, at[k]) + 1
                part.append(sides[k][at[k] : to])
                at[k] = to
            groups.append("|".join(",".join(map(str, p)) for p in part))
            links.append((part[0][-1], part[1][-1]))
        count.update(links)
        made.append((i, len(sides[0]), len(sides[1]), groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((i, a, b, len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, x in made), key=repr)


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 40])
def test_alignment_is_its_definition(spark, hard, block):
    got = sorted((tuple(r) for r in alignment.align(hard, A, B, block_bytes=block).collect()), key=repr)
    assert got == aligned([(r.doc_id, r.text) for r in hard.collect()])


def test_alignment_of_nothing(spark, hard):
    assert alignment.align(hard.limit(0), A, B).count() == 0
    assert [tuple(r) for r in alignment.align(hard.filter("text is null"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_the_two_libraries_of_side_a_agree():
    a = alignment.ByteLevel(A)
    assert a.fast is not None
    r = random.Random(3)
    signs = ["a", "The", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "日本", "𝔘", "'s", "'t", "123", "!!", "\r\n", "\u00a0", "\u2003", "İ", "\u200b", "²", "_"]
    for _ in range(3_000):
        text = "".join(r.choice(signs) for _ in range(r.randint(1, 12)))
        assert a.encode(text).tolist() == a.slow.encode(" " + text, add_special_tokens=False).ids
    gap = "x" + " " * 200_000 + "y"  # beyond the faster library
    assert a.encode(gap).tolist() == a.slow.encode(" " + gap, add_special_tokens=False).ids


def test_components_are_the_least_groups():
    r = np.random.default_rng(7)
    for _ in range(200):
        n = int(r.integers(1, 60))
        ends = [np.unique(np.r_[r.integers(1, n + 1, size=r.integers(0, n + 1)), n]) for _ in "ab"]
        cuts = np.intersect1d(*ends)
        for side, group in zip(ends, alignment.groups_of(*ends), strict=True):
            assert group.tolist() == np.searchsorted(cuts, side).tolist()
    chain = np.arange(20_000)
    assert not alignment.components(20_001, chain[::-1], chain[::-1] + 1).any()


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the")], "doc_id long, text string").repartition(3)
    counts = alignment.pair_counts(alignment.aligned_blocks(docs, A, B)).orderBy(F.desc("total")).collect()
    assert counts[0].total == 3 and counts[0].best and sum(r.total for r in counts) == 5


def test_registered(spark):
    assert {"op11_importance_resampling", "op12_url_filters", "op13_tokenizer_alignment"} <= set(queries.QUERIES)

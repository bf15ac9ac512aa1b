"""The text operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import gzip
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import fingerprints, graph, jaccard, language, lines, mixing, neighbours, packing, queries, substrings, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def table(spark, texts, **more):
    """Documents of (id, text) pairs or texts, with columns whose names clash with those the operators add."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in pairs], SCHEMA).repartition(3)
    for name in ("id", "node", "score", "size", "part", "rank", "line", "hash"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return table(spark, ["x"]).limit(0)


def shingle_set(text, width=5):
    w = (text or "").split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_copies():
    base = words(1, 120)
    out = []
    for k in range(9):
        w = list(base)
        for at in random.Random(k).sample(range(120), k % 3):
            w[at] = f"z{k}"
        out.append(" ".join(w))
    half = words(2, 100)
    out += [" ".join(half), " ".join(half[:60] + words(3, 40))]  # alike, but below the threshold
    out += [" ".join(words(s, 80)) for s in range(10, 16)]
    out += [None, "", "  \n ", "one two", "one two", "only three words", " ".join(words(50, 8000)), " ".join(words(50, 8000))]
    return out


# ---- 1: n-gram Jaccard join


def brute_links(pairs):
    sets = [(i, shingle_set(t)) for i, t in pairs]
    n, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            n[a] += 1
            n[b] += 1
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    return sorted((i, min(groups[find(k)]), n[k]) for k, (i, _) in enumerate(sets))


@pytest.mark.parametrize("chunk", [512, 2])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    pairs = list(enumerate(near_copies()))
    pairs.append(pairs[0])  # a repeated row
    pairs.append((3, " ".join(words(99, 50))))  # an id met with another text
    got = jaccard.jaccard_join(table(spark, pairs)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_links(pairs)
    assert jaccard.jaccard_join(empty(spark)).count() == 0


def test_jaccard_join_verifies_the_surviving_pairs_only(spark, monkeypatch):
    seen = []
    real = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, sets, t: seen.append(pairs) or real(pairs, sets, t))
    chain = words(5, 400)
    texts = [" ".join(chain[k * 9 : k * 9 + 100]) for k in range(30)]  # neighbours of a chain are alike, distant ones are not
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(table(spark, texts)).collect()}
    assert sorted((i, *g) for i, g in got.items()) == brute_links(list(enumerate(texts)))
    n = sum(len(r["pairs"]) // 4 for r in seen[0].collect())
    assert 29 <= n < 30 * 29 / 2 / 3  # not all pairs of the one component


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "text_keys", lambda text: [F.pmod(F.xxhash64(text), F.lit(3)).alias("node"), F.xxhash64(F.lit(17), F.length(text), text).alias("check")])
    pairs = list(enumerate(near_copies()))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(table(spark, pairs)).collect()) == brute_links(pairs)


def test_pruning_drops_only_hopeless_pairs():
    least = jaccard.least_matches()
    assert least[128] < 0.8 * 128 - 3 * np.sqrt(128 * 0.16) and least[128] > 60
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 2**32, (3, 128), dtype=np.uint32)
    sig[1] = np.where(rng.random(128) < 0.8, sig[0], sig[1])
    assert jaccard.prune(sig, np.array([0, 0]), np.array([1, 2]), least).tolist() == [0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 9), (9, 8), (20, 21)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[9] == 7 and got[21] == 20 and got[159] == 100 and got[240] == 200 and len(got) == 3 + 3 + 2 + 60 + 41


# ---- 2: language


def speak(seed, alphabet, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_language_of_unseen_texts(spark):
    rows = [(i, speak(i, a, 60), lang, "s", 0) for i in range(160) for a, lang in ((("th", "e", "ing", "wh"), "en"), (("sch", "ü", "ei", "ß"), "de"))]
    df = spark.createDataFrame([(2 * k, *r[1:]) for k, r in enumerate(rows)], SCHEMA)
    out = language.held_out(F.col("doc_id"), 5, 0)
    net = language.fit(df.filter(~out))
    got = language.classify(df.withColumn("score", F.lit("clash")).filter(out), net).collect()
    assert len(got) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (3, "12 !! 3", None, None, 0), (4, "schei " * 30000, None, None, 0), (None, "the", None, None, 0)], SCHEMA)
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.classify(odd, net).collect()}
    assert said[1] == said[2] == said[3] == ("und", 0.0) and said[4][0] == "de" and 0 < said[None][1] <= 1
    assert language.fit(odd) is None and {r["lang_pred"] for r in language.classify(odd, None).collect()} == {"und"}
    assert language.classify(empty(spark), net).count() == 0
    crc = {r["doc_id"]: r["h"] for r in df.select("doc_id", out.alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in crc.items())


def test_language_sample_holds_rare_labels(spark):
    rows = [(i, speak(i, ("th", "e", "ing", "wh"), 6), "en") for i in range(3000)] + [(5000 + i, speak(i, ("sch", "ü", "ei", "ß"), 60), "de") for i in range(4)] + [(9000, "owo uwu", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(df, windows=400).labels == ["de", "en", "xx"]


# ---- 3: fingerprints


def test_fingerprints_and_edits(spark):
    texts = near_copies() + ["ein ü wörtchen mit 😀 zeichen", "same", "same"]
    pairs = [(k * 7 % 97, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(table(spark, pairs), k=64).collect()}
    order = sorted(((i, t or "") for i, t in pairs), reverse=True)
    by_text = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r, a, b, c = got[i], shingle_set(t), shingle_set(edited), shingle_set(after)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, x in (("near_edited", b), ("near_next", c)):
            true = len(a & x) / len(a | x) if a | x else 1.0
            assert abs(r[name] - true) < (1e-9 if len(a | x) <= 64 else 0.25)
        if len(a) < 64:
            assert r["distinct_shingles"] == len(a)
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.compare_with_edits(empty(spark)).count() == 0


def test_next_document_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    ids = [5, 9, 1000, 1001, 1002, 40, 41, 7, 7, None]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next(df, ["text"]).collect()}
    order = [t for _, t in sorted(((-1 if i is None else i, f"t{k}") for k, i in enumerate(ids)), reverse=True)]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_next_document_of_uneven_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    ids = [-(2**63), 2**63 - 1, 2**60 + 1, 0, 1, 2, 3, *[None] * 20, *[77] * 20]  # outliers, and two ids of a third of all rows each
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next(df, ["text"]).collect()}
    order = [t for _, t in sorted(((-(2**70) if i is None else i, t) for i, t in rows), reverse=True)]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    from terralith.llm.common import cut_points, piece_of, sortable

    key = F.concat(sortable(F.col("doc_id")), F.hex("text"))
    cuts = cut_points(df, key, 15)
    sizes = [r["count"] for r in df.groupBy(piece_of(key, cuts)).count().collect()]
    assert len(cuts) > 8 and max(sizes) <= 9


def test_sketches_merge(spark):
    a, b = " ".join(words(1, 300)), " ".join(words(1, 300)[150:] + words(2, 200))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("d"), "a", "b").first()
    assert r["m"] == sorted(set(r["a"]) | set(r["b"]))[:128]
    x, y = shingle_set(a), shingle_set(b)
    assert abs(r["c"] - len(x & y) / len(x)) < 0.2 and abs(r["d"] / len(x) - 1) < 0.3
    parts = spark.createDataFrame([(1, r["a"]), (1, r["b"]), (2, [])], "k int, sketch array<long>")
    assert {x["k"]: x["sketch"] for x in fingerprints.merge_groups(parts, "k").collect()} == {1: r["m"], 2: []}


# ---- 4: mixing


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([10, 0], [3, 1]) == [15, 0]
    assert mixing.targets([], []) == [] and mixing.targets([0], [3]) == [0]


def test_mixing(spark):
    sizes = [random.Random(k).randint(0, 400) for k in range(120)] + [9000]
    rows = [(k, " ".join(words(k, n)) if n else [None, ""][k % 2], "en", [None, "a", "b", "c"][k % 4] if k % 3 else "a", 0) for k, n in enumerate(sizes)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash"))
    got = mixing.digest(mixing.mix(df)).collect()
    again = mixing.digest(mixing.mix(df.repartition(5))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    total = {}
    for r in got:
        t = total.setdefault(source[r["doc_id"]], [0, 0, r["source_size"], r["target"]])
        t[0] += r["size"]
        t[1] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted((s for s in total if s), key=str.encode) + [None]
    want = mixing.targets([total[s][0] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    for s, w in zip(names, want, strict=True):
        assert total[s][0] == total[s][2] and abs(total[s][3] - w) < 1e-6 and abs(total[s][1] - w) <= max(2, 0.01 * w)
    made = mixing.assemble(df).collect()
    counted = {}
    for r in made:
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    taken = {}
    for r in got:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert {k: v for k, v in taken.items() if v} == counted
    assert mixing.mix(empty(spark)).count() == 0 and mixing.assemble(empty(spark)).count() == 0


@pytest.mark.parametrize("registered", [False, True])
def test_draws_equal_a_plain_walk_of_the_tree(spark, monkeypatch, registered):
    """Every draw of every source is dealt anew, one by one, by splitting the quotas from the root down; with small blocks, and with the settings of the query."""
    if not registered:
        monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
        monkeypatch.setattr(mixing, "SHARD_BLOCKS", 16)
    scale = 50 if registered else 1
    sizes = [scale * random.Random(k).randint(0, 300) for k in range(60)] + [4000 * scale]
    df = spark.createDataFrame([(2**60 + k, " ".join(words(k, n)), "en", ["a", "b", None][k % 3], 0) for k, n in enumerate(sizes)] + [(None, "x y z", "en", "a", 0), (2**63 - 1, "p q", "en", "c", 0), (-(2**63), "r", "en", "c", 0)], SCHEMA)
    rows = df.select("doc_id", "source", F.size(F.split("text", " ")).alias("n"), F.length("text").alias("l"), F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("k")).collect()
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got.keys() == {r["doc_id"] for r in rows}
    names = ["a", "b", "c", None]
    own = {s: [(r["doc_id"], r["n"] if r["l"] else 0, r["k"]) for r in rows if r["source"] == s] for s in names}
    plan = mixing.plan_of(names, [sum(n for _, n, _ in own[s]) for s in names])
    assert plan.shards >= 4
    left = [list(range(q)) for q in plan.quota]  # each source's draws, handed down in order

    def walk(depth, index, shards, draws):
        if shards == 1:
            return [(index, s, t) for s, ts in enumerate(draws) for t in ts]
        counts = np.array([len(d) for d in draws])
        take = np.random.default_rng([plan.seed, depth, index]).multivariate_hypergeometric(counts, int(counts.sum()) // 2, method="marginals")
        return walk(depth + 1, 2 * index, shards // 2, [d[:n] for d, n in zip(draws, take)]) + walk(depth + 1, 2 * index + 1, shards // 2, [d[n:] for d, n in zip(draws, take)])

    dealt = {(s, t): shard for shard, s, t in walk(0, 0, plan.shards, left)}
    assert len(dealt) == sum(plan.quota)
    buckets = 16
    for s, name in enumerate(names):
        order = sorted(own[name], key=lambda r: (r[2] % buckets, r[2], r[0] if r[0] is not None else -(2**70), r[1]))
        sequence = [(i, w) for i, n, _ in order for w in range(n)]
        size, block, blocks = plan.sizes[s], plan.block[s], plan.blocks[s]
        turn_of = mixing.permuted(np.arange(blocks), np.full(blocks, blocks), np.full(blocks, plan.key[s]))
        assert sorted(turn_of.tolist()) == list(range(blocks))
        block_of = {int(t): k for k, t in enumerate(turn_of)}
        want, total = {}, 0
        for t in range(plan.quota[s]):
            at = sequence[block_of[t % blocks] * block : (block_of[t % blocks] + 1) * block]
            if t == plan.quota[s] - 1:
                at = at[: plan.last[s]]
            total += len(at)
            for i, w in at:
                want.setdefault(i, []).append((dealt[s, t], t // blocks, w))
        assert total == round(plan.target[s])
        for i, _, _ in own[name]:
            said = [(p["shard"], p["epoch"], w) for p in got[i]["pieces"] for w in range(p["first"], p["first"] + p["words"])]
            assert sorted(said) == sorted(want.get(i, []))


def test_quotas_are_exact():
    for size, block in ((1, 1), (7, 3), (9, 3), (10, 4), (10, 10)):
        blocks = -(-size // block)
        for place in range(blocks):
            lengths = [block] * blocks
            lengths[place] = size - block * (blocks - 1)
            for words_ in range(2 * size + 1):
                q, last = mixing.quota_of(size, block, words_, place)
                assert sum((lengths * 2)[: max(0, q - 1)]) + (last if q else 0) == words_ and last <= (lengths * 3)[max(0, q - 1)]


def test_shards_split_the_quotas():
    plan = mixing.plan_of(["a", "b"], [3_000_000, 500_000], seed=3)
    plan.shards = 8
    source = np.repeat([0, 1], plan.quota)
    draw = np.concatenate([np.arange(q) for q in plan.quota])
    shard = plan.shard_of(source, draw)
    size = np.bincount(shard, minlength=8)
    assert size.max() - size.min() <= 3 and all((np.diff(shard[source == s]) >= 0).all() for s in (0, 1))
    assert (plan.shard_of(source[::7], draw[::7]) == shard[::7]).all()
    other = mixing.plan_of(["a", "b"], [3_000_000, 500_000], seed=4)
    other.shards = 8
    assert other.quota == plan.quota and (other.shard_of(source, draw) != shard).any()  # the draws of the tree decide the shard


def test_the_registered_settings_split(spark):
    """The tree of the query itself has several shards on a table of this size, and another seed of it places the draws elsewhere."""
    rows = [(k, " ".join(words(k, 2500)), "en", "ab"[k % 2], 0) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    placed = [{r["doc_id"]: r["placed"] for r in mixing.digest(mixing.mix(df, **o)).collect()} for o in ({}, {"seed": 7})]
    shards = {p.split(":")[0] for x in placed[0].values() for p in x.split(" ") if p}
    assert len(shards) > 1 and placed[0] != placed[1]


# ---- 5: toxicity


def readings(model, text):
    import pyarrow as pa

    return {k: v for k, v in enumerate(model.readings(pa.array([text], pa.string()))[0]) if v}


def test_grammar_reads_clauses():
    m = toxicity.Model({"idiot": 1.0, "clow*": 2.0})
    assert readings(m, "an Idiot, he said") == {1: 1.0}  # aimed at him
    assert readings(m, "some idiot fell.") == {0: 1.0}
    assert readings(m, "not an idiot. idiot") == {2: 1.0, 0: 1.0}
    assert readings(m, "not one two three four idiot") == {0: 1.0}
    assert readings(m, "wrote that an idiot fell") == {4: 1.0}
    assert readings(m, "kill time") == {} and readings(m, "I will kill you") == {9: 1.0}
    assert readings(m, "you clownish idiot; fine day") == {1: 3.0}
    assert readings(m, "") == {} and readings(m, None) == {}
    assert readings(m, 'he left." idiot') == {0: 1.0} and readings(m, "(you know.) an idiot") == {0: 1.0}
    assert readings(m, "you fell\nidiot") == {0: 1.0}


def test_grammar_equals_a_plain_reading_of_clauses():
    """Every clause of five symbols at most, read word by word without transducers."""
    T = toxicity
    for n in range(6):
        for clause in itertools.product((T.OTHER, T.INSULT, T.THREAT, T.TARGET, T.NEGATION, T.REPORT), repeat=n):
            want = []
            for i, s in enumerate(clause):
                if s in (T.INSULT, T.THREAT):
                    aimed = T.TARGET in clause
                    lifted = T.NEGATION in clause[max(0, i - T.NEGATION_REACH) : i]
                    if s == T.INSULT or aimed:
                        want.append((i, aimed + 2 * lifted + 4 * (T.REPORT in clause[:i]) + 8 * (s == T.THREAT)))
            assert T.read_clause(list(clause)) == want


def test_every_transducer_counts(monkeypatch):
    nothing = lambda: toxicity.Transducer(0, {(0, s): (0, 0) for s in range(toxicity.SYMBOLS)})
    clauses = list(itertools.product(range(6), repeat=4))
    real = [toxicity.read_clause(list(c)) for c in clauses]
    for name in ("insulting", "threatening", "targeting", "negating", "reporting"):
        with monkeypatch.context() as m:
            m.setattr(toxicity, name, nothing)
            m.setattr(toxicity, "FORWARD", toxicity.tables(toxicity.grammar()))
            assert [toxicity.read_clause(list(c)) for c in clauses] != real


def test_toxicity_learns_insults(spark):
    rng = random.Random(0)
    bad = ["zorg", "blarfen", "blarfend", "blarfst"]
    rows = []
    for k in range(600):
        w = words(k, 60)
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(bad))
        rows.append((k, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("clash"))
    model = toxicity.fit(df.filter("doc_id % 3 <> 1"))
    assert {"zorg"} <= set(model.lexicon) and all(f.strip("*") in "zorg blarfend blarfst" or f.startswith("blar") for f in model.lexicon)
    got = toxicity.score(df.filter("doc_id % 3 = 1"), model).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zorg " * 50000)], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert s[1] == s[2] < 0.1 and s[3] > 0.9
    assert toxicity.fit(df.limit(0)).lexicon == {} and toxicity.score(df.limit(0), model).count() == 0


# ---- 6: nearest neighbours


def test_neighbours_find_the_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)).astype(np.float32) * rng.uniform(0.5, 2, (700, 1)).astype(np.float32)
    x[40:60] = x[40]  # equal vectors
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15), (1003, [float("nan")] + [1.0] * 15), (1004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 700, 20))
    x = x.astype(float)
    recall = []
    for q, found in got.items():
        found.sort()
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(700), -s))[:20]
        recall.append(len({v for _, v, _ in found} & set(best.tolist())) / 20)
        assert [r for r, _, _ in found] == list(range(1, 21)) and np.allclose([c for _, _, c in found], s[[v for _, v, _ in found]])
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert np.mean(recall) >= 0.9
    few = neighbours.nearest(df.filter("vec_id in (0, 1, 2, 1000)"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_every_walk_goes_on_until_no_better_node_is_met(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 48)).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    nodes = neighbours.distinct_vectors(neighbours.usable(df, "vec_id", "embedding"), 20)
    state, homes = neighbours.build(nodes, len(x), float(np.linalg.norm(x, axis=1).max()))
    graph_of = {r["id"]: np.frombuffer(r["ids"], "<i8") for r in state.select("id", "ids").collect()}
    pools = neighbours.search(state, nodes.filter("id % 10 = 0").select("id"), homes).collect()
    assert sorted(r["query"] for r in pools) == list(range(0, 2500, 10))
    for r in pools:
        pool = np.frombuffer(r["ids"], "<i8")
        met = np.setdiff1d(np.concatenate([graph_of[i] for i in pool.tolist()]), np.r_[pool, r["query"]])
        assert len(pool) >= neighbours.POOL and (x[met] @ x[r["query"]] <= (x[pool] @ x[r["query"]]).min() + 1e-4).all()


# ---- 7: substring dedup


def test_substrings_equal_brute_force(spark):
    shared, other = words(1, 75), words(2, 49)
    texts = [(10, words(3, 30) + shared + words(4, 30)), (11, words(5, 7) + shared), (12, shared[5:60] + other), (3, other + words(6, 20)), (13, other), (14, shared * 3), (15, shared + other + shared), (16, ["a"] * 300), (17, ["a"] * 120), (18, [])]
    pairs = [(i, " ".join(w)) for i, w in texts] + [(19, None), (20, "x  y\tz\n"), (10, " ".join(shared)), (21, " ".join(words(9, 9000))), (22, "  " + " ".join(words(9, 9000)) + " ")]
    first = {}
    for i, t in pairs:
        w = (t or "").split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, 10**9), i)
    want = []
    for i, t in pairs:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.digest(substrings.remove_repeats(table(spark, pairs))).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_substrings_of_a_repeated_id_are_told_apart_by_text(spark):
    shared, tail = words(1, 60), words(2, 200)
    repeat, alone = " ".join(shared + words(3, 10)), " ".join(tail)
    pairs = [(1, " ".join(shared)), (5, repeat), (5, alone), (5, repeat), (None, alone + " x"), (None, repeat + " y"), (None, " ".join(words(7, 90)))]
    got = sorted((r["doc_id"] or 99, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(table(spark, pairs)).collect())
    assert got == [(1, 60, 0), (5, 70, 60), (5, 70, 60), (5, 200, 0), (99, 71, 70), (99, 90, 0), (99, 201, 200)]


# ---- 8: web archives


def test_revisits(spark):
    rows = [
        (1, "http://www.A.org:80/x/?b=2&a=1#f", 10, "response", 200, {"etag": '"1"', "content-type": "t", "date": "d1"}, "one"),
        (2, "https://a.org/x?a=1&b=2", 20, "revisit", 304, {"etag": 'W/"1"', "date": "d2", "content-type": "no"}, None),
        (3, "a.org/x?a=1&b=2", 30, "response", 200, {"etag": '"2"', "last-modified": "m"}, "two"),
        (4, "http://a.org/x?a=1&b=2", 40, "revisit", 304, {"etag": '"1"'}, None),
        (5, "http://a.org/x?a=1&b=2", 50, "revisit", 304, {"last-modified": "m"}, None),
        (6, "http://a.org/x?a=1&b=2", 5, "revisit", 304, {"etag": '"1"'}, None),
        (7, "http://a.org/x?a=1&b=2", 60, "revisit", 304, {}, None),
        (8, "http://a.org/x?a=1&b=2", 45, "response", 404, {"etag": '"9"'}, "gone"),
        (9, None, 70, "revisit", 304, {}, None),
        (10, "http://a.org/X", 70, "revisit", 304, {"etag": '"1"'}, None),
        (11, "a.org/x?a=1&b=2", 55, "response", 200, {"ETag": '"5"', "etag": '"6"'}, ""),
        (12, "a.org/x?a=1&b=2", 56, "revisit", 304, {"Etag": '"5"', "DATE": "d"}, None),
        (13, "a.org/x?a=1&b=2", 57, "revisit", 304, None, None),
        (None, "a.org/x?a=1&b=2", 58, "revisit", 304, {}, None),
        (15, "a.org/x?a=1&b=2", None, "revisit", 304, {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, status int, headers map<string,string>, body string").withColumn("time", F.timestamp_seconds("at")).withColumn("body", F.encode("body", "UTF-8"))
    for name in ("outcome", "canonical", "_span", "_order", "_seen", "_at", "answered_by"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r["record_id"]: r for r in warc.resolve(df.unionByName(df.filter("record_id = 1"))).collect()}
    assert {k: (r["outcome"], r["answered_by"], r["body"]) for k, r in got.items()} == {
        2: ("resolved", 1, b"one"), 4: ("validator_mismatch", None, None), 5: ("resolved", 3, b"two"), 6: ("no_earlier_response", None, None), 7: ("unvalidated", None, None), 10: ("no_earlier_response", None, None),
        9: ("no_earlier_response", None, None), 12: ("resolved", 11, b""), 13: ("unvalidated", None, None), None: ("no_earlier_response", None, None), 15: ("no_earlier_response", None, None),
    }
    assert got[2]["headers"] == {"etag": 'W/"1"', "date": "d2", "content-type": "t"} and got[2]["status"] == 200
    assert warc.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows_of_a_span", [512, 4])
def test_revisits_of_a_hot_address(spark, monkeypatch, rows_of_a_span):
    """Most captures are of one address, one has a false date; each revisit against a plain search for the latest earlier response."""
    monkeypatch.setattr(warc, "SPAN_ROWS", rows_of_a_span)
    rng = random.Random(2)
    rows = []
    for k in range(150):
        url, at = ("hot.org/" if k % 3 else f"u{k % 4}.org/"), (rng.randrange(400) if k else -(10**9))
        full = rng.random() < 0.4
        rows.append((k, url, at, "response" if full else "revisit", 200 if full else 304, {"etag": str(k % 2)}, f"b{k}".encode() if full else None))
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, status int, headers map<string,string>, body binary").withColumn("time", F.timestamp_seconds("at"))
    got = {r["record_id"]: (r["outcome"], r["answered_by"], r["body"]) for r in warc.resolve(df).collect()}
    for k, url, at, kind, _, h, _ in rows:
        if kind == "revisit":
            before = [(r[2], r[0], r) for r in rows if r[1] == url and r[3] == "response" and (r[2], r[0]) < (at, k)]
            last = max(before)[2] if before else None
            assert got[k] == (("no_earlier_response", None, None) if last is None else ("resolved", last[0], last[6]) if last[5] == h else ("validator_mismatch", None, None))


def test_warc_files(spark, tmp_path):
    def record(kind, url, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}{url}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-0{1 if kind == 'response' else 2}T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    bodies = {"http://a.org/": b"caf\xe9 \x00\xff", "http://b.org/": b"x\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc", "http://c.org/": b"", "http://d.org/": b"d" * 3_000_000}
    data = [record("warcinfo", "x", b"software: none")]
    for url, body in bodies.items():
        data += [record("response", url, b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\n" + body), record("revisit", url, b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))  # a member for each record
    (tmp_path / "b.warc").write_bytes(b"".join(data))
    for name in ("a.warc.gz", "b.warc"):
        got = warc.resolve(warc.read_warc(spark, str(tmp_path / name))).collect()
        assert sorted((r["url"], r["outcome"], r["body"]) for r in got) == sorted((u, "resolved", b) for u, b in bodies.items())


# ---- 9: line dedup


def line_docs():
    a = [f"line {k}" for k in range(12)]
    texts = ["\n".join(a), "\n".join(["new"] + a[3:8] + ["x", a[0], a[2]]), "\n".join(a[:2] + ["", "  "] + a[2:4]), "same\n" * 9, "same\nsame\nother", None, "", "\n\n", "lone", " line 0 \r\n\tline 1", "\n".join(a), "\n".join(f"l{k % 7}" for k in range(900))]
    wide = " ".join(words(8, 20))  # more than MIN_CHARS characters
    texts += [f"first\n{wide}\nb", f"{wide}", f"c\n  {wide}\nd\n{wide}\n{wide[:59]}", f"e\n{wide[:59]}\nf"]
    return [(30 - k, t) for k, t in enumerate(texts)] + [(29, "line 5\nline 6"), (30, "\n".join(a)), (2**63 - 1, "line 3\nline 4")]


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_lines_equal_brute_force(spark, least):
    pairs = line_docs()
    cut = lambda t: [x.strip(lines.OUTER) for x in (t or "").split("\n")]
    xx = {(i, t): i for i, t in pairs}
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in {t for _, t in pairs}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    first, alone, want = {}, {}, {}
    order = sorted(xx, key=lambda p: (p[0], hashes[p[1]]))
    for p in order:
        ls = [x for x in cut(p[1]) if x]
        for k in range(len(ls) - least + 1):
            first.setdefault(tuple(ls[k : k + least]), (p, k))
        for k, x in enumerate(ls):
            alone.setdefault(x, (p, k))
    for p in order:
        ls = [x for x in cut(p[1]) if x]
        gone = {k for k, x in enumerate(ls) if len(x) >= lines.MIN_CHARS and alone[x] != (p, k)}
        for k in range(len(ls) - least + 1):
            if first[tuple(ls[k : k + least])] != (p, k):
                gone |= set(range(k, k + least))
        kept, n = [], 0
        for raw, x in zip((p[1] or "").split("\n"), cut(p[1]), strict=True):
            if x:
                n += 1
            if not x or n - 1 not in gone:
                kept.append(raw)
        want[p] = (len(ls), len(gone), None if p[1] is None else "\n".join(kept))
    clash = table(spark, pairs)
    for name in ("_id", "_th", "_marks", "id", "th", "first", "longest_run"):
        clash = clash.withColumn(name, F.lit("clash"))
    got = lines.dedup_lines(clash, min_lines=least).collect()
    assert {r["_marks"] + r["th"] for r in got} == {"clashclash"}
    assert sorted((r["doc_id"], r["n_lines"], r["n_lines_removed"], r["text"] or "") for r in got) == sorted((i, *want[i, t][:2], want[i, t][2] or "") for i, t in pairs)
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_longest_run_and_documents_without_id(spark):
    a = [f"l{k}" for k in range(7)]
    pairs = [(1, "\n".join(a)), (2, "\n".join(["x", *a, "y"])), (None, "p\nq"), (2**63 - 1, "p\nq"), (None, "p\nq")]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_lines_removed"], r["longest_run"]) for r in lines.dedup_lines(table(spark, pairs)).collect())
    assert got[:2] == [(False, 1, 0, 0), (False, 2, 7, 7)] and got[3] == got[4] and got[2][2] + got[3][2] == 2  # one of the two documents gives way


def test_ranks_are_the_suffix_array(spark):
    pairs = line_docs()
    df = table(spark, pairs)
    ranked, _ = lines.repeated_runs(df)
    every = {(r["id"], r["th"], r["line"]): r["h"] for r in lines.line_table(df, "doc_id", "text").collect()}
    rank = {(r["id"], r["th"], r["line"]): r["rank"] for r in ranked.collect()}
    assert sorted(rank.values()) == list(range(len(rank)))

    def suffix(p):
        out = []
        while p in rank:
            out.append(every[p])
            p = (p[0], p[1], p[2] + 1)
        return out

    by_rank = [suffix(p) for p in sorted(rank, key=rank.get)]
    for a, b in itertools.pairwise(by_rank):
        n = min(len(a), len(b))
        assert a[:n] <= b[:n]  # equal up to the shorter one's terminator, or in order


# ---- 10: packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [" ".join(words(k, n)) for k, n in enumerate((1, 5, 40, 3000))] + [None, "", "Ünïcode, don't. ΑΣ. x.,y 12 ́a İ <|endoftext|> 中文", "word " * 9000]
    pairs = list(enumerate(texts)) + [(1, texts[1])]
    got = packing.pack(table(spark, pairs), queries.TOKENIZER).collect()
    tok = Tokenizer.from_file(queries.TOKENIZER)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0 and 1 << r["bucket"] == r["length"]
    assert len({r["sequence_id"] for r in got}) == len(got)
    for i, t in enumerate(texts):
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        pieces = sorted(set(by[i]))
        assert b"".join(p[2] for p in pieces) == want and [p[0] for p in pieces] == [sum(q[1] for q in pieces[:k]) for k in range(len(pieces))]
        assert all(p[3] * 4 == len(want) for p in pieces)
    assert {r["ids_crc32"] for r in packing.digest(packing.pack(table(spark, [(0, None)]), queries.TOKENIZER)).collect()} == {zlib.crc32((2).to_bytes(4, "little"))}
    assert packing.pack(empty(spark), queries.TOKENIZER).count() == 0
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.piece_lengths(0) == []


# ---- all: ids at the ends of their range, no id, repeated rows, clashing names, a very long text, an empty table


HARD_IDS = [-(2**63), 2**63 - 1, 2**60 + 1, None, 5, 5]


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op9", "op10"])
def test_hard_rows(spark, name):
    long = " ".join(words(77, 700_000))  # some four megabytes
    texts = [" ".join(words(k, 60)) for k in range(4)] + ["same text of five words"] * 2
    pairs = [*zip(HARD_IDS, texts, strict=True), (9, long), (10, None), (11, ""), (None, texts[0])]
    df = table(spark, pairs)
    for column in ("_id", "_hash", "_key", "_range", "_marks", "_bucket", "_source", "key", "vertex", "at"):
        df = df.withColumn(column, F.lit("clash"))
    known = {(i, t) for i, t in pairs}
    run = {
        "op1": lambda d: jaccard.jaccard_join(d),
        "op2": lambda d: language.classify(d, None).select("doc_id", "lang_pred"),
        "op3": fingerprints.compare_with_edits,
        "op4": lambda d: mixing.digest(mixing.mix(d)),
        "op5": lambda d: toxicity.score(d, toxicity.Model({"w1": 1.0})).select("doc_id", "score"),
        "op7": lambda d: substrings.digest(substrings.remove_repeats(d)),
        "op9": lambda d: lines.digest(lines.dedup_lines(d)),
        "op10": lambda d: packing.digest(packing.pack(d, queries.TOKENIZER)).filter("start = 0"),
    }[name]
    got = [r["doc_id"] for r in run(df).collect()]
    assert sorted(got, key=repr) == sorted((i for i, _ in pairs), key=repr) and len(known) == len(pairs) - 1
    assert run(df.limit(0)).count() == 0


def test_one_of_each_keeps_every_column(spark):
    df = table(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2**63 - 1, "q r s t u v")]).withColumn("_id", F.lit(9)).withColumn("_node", F.lit(3))
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns and sorted((r["doc_id"], r["_id"], r["_node"]) for r in got.collect()) == [(5, 9, 3), (2**63 - 1, 9, 3)]


def test_network_equals_plain_convolutions():
    rng = np.random.default_rng(0)
    net = language.train(rng.integers(1, 70, (40, 32), dtype=np.uint8), rng.integers(0, 3, 40), ["a", "b", "c"], epochs=1)
    x = rng.integers(0, 70, (3, 32), dtype=np.uint8)
    for row, said in zip(x, net.probabilities(x), strict=True):
        h = []
        for f in range(net.filters.shape[1]):
            w = net.filters[:, f].reshape(-1, net.embed.shape[1])
            best = max(sum(float(net.embed[row[i + k] if i + k < len(row) else 0] @ w[k]) for k in range(len(w))) for i in range(len(row)))
            h.append(max(0.0, best + float(net.bias[f])))
        z = np.array(h) @ net.out_w + net.out_b
        p = np.exp(z - z.max())
        assert np.allclose(p / p.sum(), said, atol=1e-4)

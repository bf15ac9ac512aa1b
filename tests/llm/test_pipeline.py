"""Each stage of the pipeline on what the stage before kept, against brute force; then the whole run."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_links, speak, words

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = []
    for k in range(120):
        alphabet, lang = ((("th", "e", "ing", "wh"), "en"), (("sch", "ü", "ei", "ß"), "de"))[k % 2]
        body = [speak(1000 * k + j, alphabet, rng.randint(8, 30)) for j in range(4)]
        texts.append(("\n".join(body), lang))
    texts[7] = (texts[3][0] + " th", "de")
    texts += [(texts[9][0], "de"), ("\n".join(texts[11][0].split("\n")[:2] + [speak(5, ("sch", "ü"), 40)]), "de"), (None, None), ("", "en"), ("12 34 !!", "en")]
    rows = [(i, t, lang, f"s{i % 4}" if i % 9 else None, len(t or "")) for i, (t, lang) in enumerate(texts)]
    rows.append(rows[20])
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        rows_in = before.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":
            gone = {r["doc_id"] for r in rows_in} - {r["doc_id"] for r in kept[name]}
            assert gone == {r["doc_id"] for r in rows_in if not any(map(str.isalpha, r["text"] or ""))}
            assert sum(r["lang"] == ("en" if any(w in r["text"][:40] for w in ("th", "wh", "ing")) else "de") for r in kept[name]) >= 0.97 * len(kept[name])
        if name == "lines":
            first, want = {}, {}
            order = sorted({(r["doc_id"], r["text"]) for r in rows_in})
            for i, t in order:
                ls = t.split("\n")
                for k in range(len(ls)):
                    first.setdefault(tuple(ls[k : k + 2]), (i, k))
                    first.setdefault(ls[k], (i, k))
            for i, t in order:
                ls = t.split("\n")
                drop = {x for k in range(len(ls) - 1) if first[tuple(ls[k : k + 2])] != (i, k) for x in (k, k + 1)} | {k for k, x in enumerate(ls) if len(x) >= 60 and first[x] != (i, k)}
                left = "\n".join(x for k, x in enumerate(ls) if k not in drop)
                if left:
                    want[i] = left
            assert {r["doc_id"]: r["text"] for r in kept[name]} == want and all(r["n_chars"] == len(r["text"]) for r in kept[name])
        if name == "near_duplicates":
            links = brute_links([(r["doc_id"], r["text"]) for r in rows_in])
            assert sorted(r["doc_id"] for r in kept[name]) == sorted({c for _, c, _ in links})
            assert len({(r["doc_id"], r["text"]) for r in kept[name]}) == len(kept[name])
        if name == "mixing":
            from terralith.llm import mixing

            size, taken = {}, {}
            for r in rows_in:
                size[r["source"]] = size.get(r["source"], 0) + len(r["text"].split())
            for r in kept[name]:
                taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
            names = [*sorted(s for s in size if s), None]
            target = mixing.targets([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
            assert all(abs(taken[s] - t) <= max(3, 0.01 * t) for s, t in zip(names, target, strict=True))
        if name == "packing":
            assert sum(r["length"] for r in kept[name] if r["start"] == 0 or r["start"]) == sum(r["length"] for r in kept[name])
            whole = sum(r["doc_tokens"] for r in kept[name] if r["start"] == 0)
            assert whole == sum(r["length"] for r in kept[name]) and all(r["length"] & (r["length"] - 1) == 0 for r in kept[name])


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert words(1, 3) == words(1, 3)

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from primeweave.llm import decontamination, pipeline, queries, toxicity

from .conftest import prose
from .test_operators import jaccard_components, removed_by_brute_force

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], COLUMNS)


def test_stages_are_declared():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:5] and 0 < got.select("doc_id").distinct().count() < docs.count()
    for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect():
        assert r.n == r.m <= 4096


def test_stages_on_odd_texts(spark, odd_texts, tmp_path):
    path = str(tmp_path / "docs")
    table(spark, odd_texts).write.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.read.parquet(path), SF)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = str(tmp_path / name)
        out.write.parquet(path)
    left = spark.read.parquet(path)
    ids = {r.doc_id for r in left.select("doc_id").distinct().collect()}
    assert {1, 4, 5, 6, 7, 9, 10, 11} <= ids and not {2, 3, 8} & ids


def test_decisions(spark, tmp_path):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").limit(1).collect()
    base, shared = prose(50, 200), prose(51, 60)
    texts = [(1, base), (2, base + " more"), (3, items[0].text), (4, prose(52, 30) + "\n" + shared), (5, prose(53, 30) + "\n" + shared), (6, None)]
    path = str(tmp_path / "d")
    table(spark, texts).write.parquet(path)
    docs = spark.read.parquet(path)
    near = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert near == {1, 3, 4, 5, 6}
    clean = {r.doc_id for r in pipeline.drop_contaminated(spark, docs, SF).collect()}
    assert clean == {1, 2, 4, 5, 6}
    lines = {r.doc_id: r for r in pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert lines[4].text == texts[3][1] and lines[5].text == prose(53, 30) and lines[5].n_chars == len(prose(53, 30)) and 2 not in lines and lines[6].text is None


def test_run_against_brute_force(spark, tmp_path):
    """The whole pipeline by plain loops over a small table with toxic, copied, contaminated and null texts, and repeated ids."""
    r = random.Random(21)
    items = [(k, prose(700 + k, r.choice([6, 20, 60]))) for k in range(12)]
    texts, toxic = [], []
    for k in range(260):
        words = prose(8000 + k, r.choice([4, 30, 120, 300])).split()
        if k % 4 == 0:
            for _ in range(len(words) // 6 + 2):
                words.insert(r.randrange(len(words)), r.choice(["grobian", "schuft", "halunke", "trottel"]))
            toxic.append(k)
        text = " ".join(words)
        if k % 5 == 1:
            text += "\n" + prose(r.randrange(6), 55)
        if k % 13 == 2:
            text += " " + r.choice(items)[1]
        texts.append((k, text))
    for k in range(260, 300):
        words = texts[r.randrange(260)][1].split(" ")
        words[r.randrange(len(words))] = "edited"
        texts.append((k, " ".join(words)))
    texts += [texts[7], (300, None), (301, ""), (302, None)]
    folder = str(tmp_path)
    table(spark, texts).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, int(k in toxic)) for k in range(260)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()

    distances, curve = toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    left = [(i, t) for i, t in texts if curve(np.array([toxicity.figures(distances.of(t))]))[0] < 0.5]
    assert len(left) < 0.85 * len(texts)
    # rows of one id keep their order, so that each finds its own lines
    order = sorted(range(len(left)), key=lambda k: left[k][0])
    lines = removed_by_brute_force([((left[k][0], k), left[k][1]) for k in order])
    left = [(i, t) for ((i, k), t) in sorted(lines, key=lambda x: x[0][1]) if t == left[k][1] or t.strip()]
    component = jaccard_components([((i, k), t) for k, (i, t) in enumerate(left)])
    left = [left[k] for (i, k), (_, first) in component.items() if first == (i, k)]
    found = decontamination.brute_force([((i, k), t) for k, (i, t) in enumerate(left)], items)
    left = [left[k] for (i, k), (n, hit, _) in found.items() if not (hit and 20 * hit >= n)]
    assert {i for i, _ in left} >= {300, 301, 302} and 100 < len(left) < 220

    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in left:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for a in range(0, len(ids), 4096):
            own = ids[a : a + 4096]
            want[i, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(ids)] += 1
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    at: dict = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == at.get(x.sequence_id, 0)
        at[x.sequence_id] = x.offset + x.length
    assert max(at.values()) <= 4096


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, spark.createDataFrame([], COLUMNS), SF).count() == 0

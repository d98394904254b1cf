import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from primeweave.llm import decontamination, embedding_dedup, fm_index, language_id, line_dedup, ngram_join, packing, quality, shingles, token_counts, toxicity, warc
from primeweave.llm.shared import Stages, components

from .conftest import prose

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# connected components


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = {x: top(x) for x in list(root) if any(x in e and e[0] != e[1] for e in edges)}
    got = {r.id: r.component for r in components(Stages(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(Stages(spark), spark.createDataFrame([], "a long, b long")).count() == 0


# 1 decontamination


def test_suffix_array_and_index():
    r = np.random.default_rng(3)
    for n, m in ((0, 3), (1, 3), (300, 2), (500, 9)):
        t = r.integers(1, m + 1, n)
        t[r.random(n) < 0.1] = 0
        if n:
            t[-1] = 0
        keys = t.astype(np.int64) + 1000
        keys[t == 0] = np.arange((t == 0).sum())
        assert fm_index.suffix_array(keys).tolist() == sorted(range(n), key=lambda k: keys[k:].tolist())
        index = fm_index.FMIndex(t)
        patterns = np.array([[1, 1], [1, 2], [2, m], [m + 5, 1]])
        lo, hi = index.find(patterns)
        for p, a, b in zip(patterns.tolist(), lo, hi, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(n - 1) if t[k : k + 2].tolist() == p]


def contaminated_rows(spark, docs, items):
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.n_words): r for r in decontamination.contamination(docs, b).collect()}


def test_contamination(spark, odd_docs, odd_texts, monkeypatch):
    long_item = " ".join(prose(1, 120).split()[20:50])
    items = [(10, long_item), (2, long_item), (3, "one TWO"), (4, None), (5, "..."), (6, "日本"), (7, prose(77, 30))]
    want = decontamination.brute_force(odd_texts, items)
    for size in (16 << 20, 40):  # one broadcast, several
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = decontamination.contamination(odd_docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert len(got) == len(odd_texts)
        assert all((r.n_words, r.n_hit, r.item_ids) == want[r.doc_id] for r in got)
    spans = next(r.spans for r in got if r.doc_id == 1)
    text = dict(odd_texts)[1]
    assert [text[s["start"] : s["end"]] for s in spans] == [long_item]
    assert long_item not in decontamination.removed(text, [s.asDict() for s in spans])


def test_contamination_of_nothing(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(no_docs, none).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.contamination(odd_docs, none).collect())


# 2 embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string, pivot int")


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(6)
    base = r.normal(size=(30, 24))
    rows = []
    for k in range(400):
        v = base[r.integers(30)] + r.normal(size=24) * r.choice([0.0, 0.05, 0.15, 0.4])
        rows.append((k, [float(np.float32(x)) for x in v], int(r.integers(2)), "z", 1))
    rows += [(400, None, 1, "z", 1), (401, [0.0] * 24, 1, "z", 1), (402, [float("nan")] * 24, 1, "z", 1), (403, [None] * 24, 1, "z", 1), (404, rows[0][1], None, "z", 1), (405, [], 1, "z", 1)]
    good = {i: (np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab, *_ in rows[:400]}
    links = {i: {j for j in good if j != i and good[i][1] == good[j][1] and float(good[i][0] @ good[j][0]) >= 0.98} for i in good}
    comp = {}
    for i in sorted(good):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert len(got) == 406
    wanted, found = sum(map(len, links.values())), sum(got[i].n_links for i in good)
    assert 0.95 * wanted <= found <= wanted and all(got[i].n_links <= len(links[i]) for i in good)
    assert sum(got[i].component_id == comp[i] for i in good) >= 0.98 * 400
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(400, 406))


@pytest.mark.parametrize("groups,rest", [(1, 4000), (12, 0)])
def test_embeddings_in_dense_groups(spark, groups, rest):
    """A third of the rows, or all of them in a few groups, are distinct near copies."""
    r = np.random.default_rng(groups)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = np.repeat(unit(r.normal(size=(groups, 64))), 2000 if groups == 1 else 500, axis=0)
    x = np.concatenate([unit(centre + r.normal(size=centre.shape) * np.sqrt(0.015 / 0.985 / 64)), unit(r.normal(size=(rest, 64)))]).astype(np.float32)
    y = unit(x.astype(float))
    want = (y @ y.T >= 0.98).sum(1) - 1
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(vectors(spark, [(k, v, 1, "z", 1) for k, v in enumerate(x.tolist())])).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert want.sum() > 10**6 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_embeddings_with_repeated_ids_and_lengths(spark):
    a, b, c, d = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.995, 0.0998], [1.0, 0.05, 0.0]
    rows = [(1, a), (2, a), (1, b), (5, b), (6, c), (7, d), (8, [1.0, 0.0]), (9, [2.0, 0.01]), (None, a), (None, [0.0, 0.0, 1.0])]
    got = Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(vectors(spark, [(i, v, 1, "z", 1) for i, v in rows])).collect())
    want = [(1, 3, 1, True), (2, 3, 1, False), (1, 2, 1, True), (5, 2, 1, False), (6, 2, 1, False), (7, 3, 1, False), (8, 1, 8, True), (9, 1, 8, False), (None, 3, None, False), (None, 0, None, True)]
    assert {k[:3]: n for k, n in got.items()} == {k[:3]: n for k, n in Counter(want).items()}


def test_embeddings_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HOT", 3)
    rows = [(k, [1.0, 0.0], 1, "z", 1) for k in range(40)] + [(k, [0.0, float(k)], 1, "z", 1) for k in range(40, 43)]
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert all((got[k].n_links, got[k].component_id) == ((39, 0) if k < 40 else (2, 40)) for k in got) and len(got) == 43


def test_prefixes_are_ordered_and_counted():
    r = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, pivots = unit(r.normal(size=(60, 16))), unit(r.normal(size=(40, 16)))
    near = embedding_dedup.prefixes(x, pivots)
    order = np.argsort(-(x @ pivots.T), axis=1)
    assert (near[:, 0] == order[:, 0]).all()
    for k in range(60):
        own = [p for p in near[k] if p >= 0]
        assert own == [p for p in order[k] if p in own]
    found = embedding_dedup.shared_homes(near[:30], near[30:])
    for i in range(30):
        for j in range(30):
            assert found[i, j] == (near[i, 0] in near[30 + j] and near[30 + j, 0] in near[i])


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


# 3 quality


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(8)
    parts = {"en": "th he in er an re on at en nd".split(), "fr": "es le de en re nt on er te el".split(), "de": "en er ch te nd ie ei un sc st".split()}
    rows = []
    for k in range(420):
        lang = r.choice(list(parts))
        text = " ".join("".join(r.choices(parts[lang], k=r.randint(1, 4))) for _ in range(60))
        good = k % 7 != 0
        rows.append((k, text if good else "".join(r.choices("#$%&0123456789", k=300)), lang, int(good)))
    return rows


def test_quality(spark, languages):
    rows = [*languages, (1000, None, "en", 0), (1001, "", None, 0), (1002, languages[1][1], None, 0), (1003, languages[1][1], "xx", 0)]
    docs = spark.createDataFrame([(a, b, c, "z") for a, b, c, _ in rows], "doc_id long, text string, lang string, gram string")
    labels = spark.createDataFrame([(a, d) for a, _, _, d in languages if a % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[a].kept for a, *_, d in languages if d]) > 0.9 and not any(got[a].kept for a, *_, d in languages if not d)
    assert got[1000].perplexity is None and not got[1000].kept and not got[1001].kept and got[1002].perplexity > 0
    joined = {r.doc_id: r.perplexity for r in quality.judged(docs, labels, most=0).collect()}
    assert joined.keys() == got.keys() and all(p == got[k].perplexity or abs(p / got[k].perplexity - 1) < 1e-14 for k, p in joined.items())


def kneser_ney(texts, order=5):
    """(probabilities, weights) of byte n-grams by their textbook definition."""
    pad = b" " * (order - 1)
    counts = {order: Counter(x[k : k + order] for t in texts for x in [pad + t] for k in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    probability, weight = {}, {}
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = {j: max(0.05, min(j - 0.05, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 * j for j in (1, 2, 3)}
        total, held = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3)]
        weight |= {(k, x): held[x] / total[x] for x in total}
        probability |= {g: (c - d[min(c, 3)]) / total[g[:-1]] + weight[k, g[:-1]] * (probability[g[1:]] if k > 1 else 1 / 256) for g, c in counts[k].items()}
    return probability, weight


def test_quality_against_the_definition(spark, languages):
    trusted = [(c if k % 5 else "*", b) for k, (a, b, c, d) in enumerate(languages) if d and k < 200]
    docs = [(a, c, b) for a, b, c, _ in languages[150:]] + [(9000, "xx", "Übung th er"), (9001, None, "a"), (9002, "en", "")]
    got = {r.id: r.perplexity for r in quality.perplexities(Stages(spark), spark.createDataFrame(docs, "id long, lang string, text string"), spark.createDataFrame(trusted, "lang string, text string")).collect()}
    models = {lang: kneser_ney([t.encode() for x, t in trusted if lang in (x, "*")] if lang == "*" else [t.encode() for x, t in trusted if x == lang]) for lang in ("en", "fr", "de")}
    models["*"] = kneser_ney([t.encode() for _, t in trusted])
    for i, lang, text in docs:
        raw, h = text.encode().translate(quality._LOWER), 0.0
        probability, weight = models.get(lang, models["*"])
        padded = b"    " + raw
        for k in range(len(raw)):
            gram, p = padded[k : k + 5], 1.0
            while gram and gram not in probability:
                p *= weight.get((len(gram), gram[:-1]), 1.0)
                gram = gram[1:]
            h -= np.log(p * (probability[gram] if gram else 1 / 256))
        assert got[i] is None if not raw else abs(got[i] - np.exp(h / len(raw))) < 1e-5 * got[i]


@pytest.mark.parametrize("null", [lambda lang: True, lambda lang: lang == "fr"])
def test_quality_of_trusted_texts_without_language(spark, languages, null):
    docs = spark.createDataFrame([(a, b, None if null(c) else c) for a, b, c, _ in languages], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(a, d) for a, _, _, d in languages if a % 2], "doc_id long, quality int")
    own = {a: d for a, _, c, d in languages if null(c)}
    for most in (quality.MODEL_ROWS, 0):
        got = {r.doc_id: r for r in quality.judged(docs, labels, most=most).collect()}
        assert len(got) == len(languages) and all(got[a].perplexity < 30 for a, d in own.items() if d)
        assert np.mean([got[a].kept for a, d in own.items() if d]) > 0.9 and not any(got[a].kept for a, d in own.items() if not d)


def test_quality_is_a_distribution(spark):
    """Probabilities of all bytes after a context sum to 1."""
    docs = spark.createDataFrame([("en", "abracadabra abra cadabra"), ("en", "banana bandana")], "lang string, text string")
    table = quality.model_tables(Stages(spark), docs).toPandas()
    langs = sorted(table["lang"].unique())
    lang = np.searchsorted(np.array(langs, object), table["lang"].to_numpy(object))
    keys = np.array([int(quality.Lookup.key(int(a), int(k), np.array([g]))[0]) for a, k, g in zip(lang, table["kind"], table["gram"], strict=True)], np.uint64)
    model = quality.Lookup.build(langs, keys, table["v"].to_numpy(np.int32))
    for context in (b"abra", b"zzzz", b"bana", b" ban"):
        code = np.array([int.from_bytes(context + bytes([w]), "big") for w in range(256)])
        assert abs(np.exp(model.logp(langs.index("en"), code) / quality.ONE).sum() - 1) < 1e-3


def test_quality_without_labels(spark, languages, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judged(no_docs, labels).count() == 0
    docs = spark.createDataFrame([(a, b, c) for a, b, c, _ in languages[:5]], "doc_id long, text string, lang string")
    assert all(abs(r.perplexity - 256) < 1e-3 and not r.kept for r in quality.judged(docs, labels).collect())


# 4 toxicity


def test_windows_cover():
    for seed, n in ((1, 0), (2, 5), (3, 400)):
        text = prose(seed, n).encode()
        parts = toxicity.windows(text)
        at = 0
        for p in parts:
            k = text.find(p, max(0, at - toxicity.WINDOW))
            assert 0 <= k <= at
            at = max(at, k + len(p))
        assert at == len(text)
    assert b"".join(toxicity.windows(b"x" * 81)).count(b"x") >= 81


def test_toxicity_held_out(spark, odd_docs, no_docs):
    r = random.Random(12)
    bad = ["grobian", "schuft", "halunke", "trottel", "lump"]
    rows = []
    for k in range(900):
        words = prose(5000 + k, r.randint(30, 200)).split()
        toxic = k % 3 == 0
        for _ in range(r.randint(3, 8) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if zlib.crc32(str(a).encode()) % 5] + [(3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [(a, c) for a, _, c in rows if not zlib.crc32(str(a).encode()) % 5]
    assert np.mean([got[a].predicted for a, c in held if c]) > 0.9 and np.mean([got[a].predicted for a, c in held if not c]) < 0.1
    distances, curve = model
    for a, text, _ in rows[::9]:  # by hand: lengths under either compressor, window by window
        own = [len(distances.ordinary.compress(w)) - len(distances.toxic.compress(w)) for w in toxicity.windows(text.encode())]
        assert abs(got[a].score - curve(np.array([toxicity.figures(np.array(own))]))[0]) < 1e-12 and got[a].n_windows == len(own)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in odd)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert all(x.score == 0 for x in toxicity.score(odd_docs, None).collect())


def test_all_expressions_are_in_the_dictionary(spark):
    """However many toxic words there are; the first and last words of texts count too."""
    r = random.Random(13)
    bad = sorted({"".join(r.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(700)})
    rows = []
    for k in range(2700):
        words = prose(9000 + k, 13).split()
        if k % 3 == 0:
            words = [bad[(k // 3 * 14) % len(bad)], *(x for j, w in enumerate(words) for x in (w, bad[(k // 3 * 14 + j + 1) % len(bad)]))]
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    distances, _ = toxicity.learn(docs, spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int"))
    assert sum(w.encode() in distances.kept[1] for w in bad) >= 0.9 * len(bad)
    assert np.mean([distances.of(f"{w} alpha3 beta7")[0] >= 3 for w in bad]) > 0.9


# 5 packing


def test_histogram_packing():
    r = random.Random(2)
    for counts in ({}, {4096: 3}, {100: 1000}, {1: 5000, 4000: 7}, {r.randint(1, 4096): r.randint(1, 50) for _ in range(400)}):
        patterns = packing.pack_histogram(dict(counts), 4096)
        placed = Counter()
        for pattern, n in patterns:
            assert sum(length * times for length, times in pattern) <= 4096
            for length, times in pattern:
                placed[length] += times * n
        assert placed == Counter(counts)
        total = sum(k * n for k, n in counts.items())
        if total > 10 * 4096 and len(counts) > 100:
            assert sum(n for _, n in patterns) <= 1.05 * -(-total // 4096)


def test_packed_round_trip(spark, odd_docs, odd_texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    got = packing.packed(odd_docs, WORD, end_id=2, capacity=512).collect()
    whole = Counter(b"".join(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _ in [0]) for _, t in odd_texts)
    sequences = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    seen = Counter()
    for (doc, total), parts in by.items():
        copies = len(parts) // len({s for s, _ in parts})
        ids = b"".join(x for _, x in sorted(set(parts)))
        assert len(ids) == 4 * total
        seen[ids] += copies
    assert seen == whole and len(sequences) == max(sequences) + 1


def test_nothing_packed(no_docs):
    assert packing.packed(no_docs, WORD, end_id=2).count() == 0


def test_words_encode_alone():
    words, r = packing.word_ids(WORD), random.Random(1)
    parts = ["a", "B", "É", "ß", "Σ", "'s", "'", " ", "\n", ".", ",", "!", "\t", " ", "́", "İ", "<|endoftext|>", "<|", "日", "12", "The", "😀"]
    for _ in range(1500):
        t = "".join(r.choices(parts, k=r.randint(0, 10)))
        assert np.frombuffer(words.encode(t), "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


# 6 lines


def removed_by_brute_force(docs):
    seen, out = [], []
    for doc, text in sorted(docs, key=lambda d: d[0]):
        gone = set()
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            w = [x for x in re.sub("[\t\r\x0b\x0c]", " ", line.lower()).split(" ") if x]
            if w:
                s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
                if any(len(s & t) >= 0.75 * len(s | t) for t in seen):
                    gone.add(k)
                seen.append(s)
        out.append((doc, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)))
    return sorted(out, key=lambda r: (r[0], str(r[1])))


@pytest.mark.parametrize("hub", [32, 1])
def test_lines(spark, odd_docs, odd_texts, no_docs, monkeypatch, hub):
    monkeypatch.setattr(line_dedup, "HUB", hub)
    r = random.Random(7)
    docs = []
    for k in range(120):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = prose(r.randrange(40), r.choice([3, 12, 40])).split()
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(["new", "words", "here"])
            lines.append(" ".join(w))
        docs.append((100 + k, "\n".join(lines)))
    got = line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=lambda r: (r[0], str(r[1]))) == removed_by_brute_force(docs)
    odd = line_dedup.deduplicated(odd_docs).collect()
    assert sorted(((x.doc_id, x.text) for x in odd), key=lambda r: (r[0], str(r[1]))) == removed_by_brute_force(odd_texts)
    assert line_dedup.deduplicated(no_docs).count() == 0


def test_lines_of_words_with_equal_short_hashes(spark):
    """Spark's 32-bit hashes of these numbers are equal."""
    docs = [(1, "10106540"), (2, "10147603"), (3, "page 10106540 of it"), (4, "page 10147603 of it\n10106540")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert spark.sql("select hash('10106540') = hash('10147603')").first()[0]
    assert {x.doc_id: (x.text, x.n_removed) for x in line_dedup.deduplicated(frame).collect()} == {1: (docs[0][1], 0), 2: (docs[1][1], 0), 3: (docs[2][1], 0), 4: ("page 10147603 of it", 1)}


# 7 WARC


@pytest.mark.parametrize("hot", [10_000, 1])
def test_archives(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(5, "http://a b\n", trap), (1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (6, "u", "é" * 1000), (7, "u", trap + trap), (8, "u", "WARC/1.1\r\n")]
    pages = spark.createDataFrame([(*x, 1, 2) for x in rows], "page_id long, url string, html string, id int, sha int")
    path = str(tmp_path / "w")
    warc.write(pages, path)
    got = {r.id: r for r in warc.read(spark, path).collect()}
    assert sorted(got) == list(range(1, 9))
    assert (got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("revisit", 1, 4)
    assert (got[4].record_type, got[4].refers_to) == ("revisit", 3) and got[1].record_type == "response"
    import base64
    import hashlib

    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    plain = "".join(r.value + warc.END for r in warc.records(pages).collect()).encode()
    start, _, after, _ = warc.candidates(plain)
    assert len(start) > 8 and warc.reachable(start, after, len(plain)).sum() == 8
    with pytest.raises(ValueError):
        warc.reachable(start, after, len(plain) + 1)


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "e")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


# 8 token counts


def test_token_counts(spark, odd_docs, odd_texts, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counts = token_counts.prefix_token_counts(odd_docs, PIECE)
    got = counts.collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in odd_texts)
    for r in got:
        text = next(t for i, t in odd_texts if i == r.doc_id) or ""
        sums = np.cumsum(np.frombuffer(r.prefix_deltas, np.int8), dtype=int)
        assert len(sums) == len(text)
        for k in range(0, min(len(text), 300), 7):
            assert sums[k] == len(sp.encode(text[: k + 1]))
    asked = counts.where("doc_id = 11").select(token_counts.tokens_before(F.col("prefix_deltas"), F.lit(500)).alias("t"), token_counts.fitting_prefix(F.col("prefix_deltas"), F.lit(100)).alias("c")).first()
    text = dict(odd_texts)[11]
    assert asked.t == len(sp.encode(text[:500])) and len(sp.encode(text[: asked.c])) <= 100 < len(sp.encode(text[: asked.c + 1]))
    assert token_counts.prefix_token_counts(no_docs, PIECE).count() == 0


def test_prefix_counts_at_random():
    s, r = token_counts.solver(PIECE), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "ß", "日", "\t", "<0x0A>", "</s>", "ﬁ", "😀", "1", "'", "…", "in", "g"]
    for _ in range(500):
        t = "".join(r.choices(parts, k=r.randint(0, 20)))
        assert int(np.frombuffer(s.deltas(t), np.int8).sum(dtype=int)) == len(s.sp.encode(t))


# 9 language


def test_language_held_out(spark, languages, odd_docs, no_docs):
    rows = [(a, b, c) for a, b, c, d in languages if d]
    docs = spark.createDataFrame([*rows, (900, "lost", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [(a, c) for a, _, c in rows if zlib.crc32(str(a).encode()) % 4 == 2]
    assert np.mean([got[a].lang_pred == c for a, c in held]) > 0.97
    odd = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (4, 5, 6)) and odd[1].lang_pred != "und"
    assert language_id.predict(no_docs, model).count() == 0
    assert language_id.train(no_docs) is None
    assert all(r.lang_pred == "und" for r in language_id.predict(odd_docs, None).collect())


def test_decoding_against_the_definition(spark, languages, odd_texts):
    """Margins, losses and the nearest codeword, a trigram and a bit at a time."""
    docs = spark.createDataFrame([(a, b, c) for a, b, c, d in languages if d], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    texts = [(a, b) for a, b, *_ in languages[:40]] + [(k, t) for k, t in odd_texts if k in (1, 9, 12, 14)]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, text in dict(texts).items():
        raw = low(text).encode()
        of = [language_id.grams(np.frombuffer(raw[k : k + 3], np.uint8))[0] for k in range(len(raw) - 2)]
        loss = []
        for k in range(len(model.langs)):
            total = 0.0
            for bit in range(model.code.shape[1]):
                margin = sum(float(model.table[f, bit]) for f in of) / max(len(of), 1) / model.scale[bit]
                total += model.weight[bit] * np.exp(-min(max(margin, -8), 8) * model.code[k, bit])
            loss.append(total)
        chance = np.exp(-4 * (np.array(loss) - min(loss)))
        chance /= chance.sum()
        assert got[i].lang_pred == model.langs[int(np.argmin(loss))] and abs(got[i].score - chance.max()) < 1e-4
        assert got[i].ambiguous == (sorted(chance)[-2] > 0.25)


@pytest.mark.parametrize("n", [1, 2, 4, 6, 40])
def test_codewords(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and len(np.unique(code, axis=0)) == n or n == 1
    assert n == 1 or (np.abs(code.sum(0)) < n).all()


# 10 n-gram join


def jaccard_components(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    changed = True
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def near_copies(families, copies, seed, passage=""):
    r, rows = random.Random(seed), []
    for f in range(families):
        base = prose(900 + f, r.choice([20, 60, 200]))
        for _ in range(copies):
            w = base.split()
            for _ in range(r.choice([0, 1, 2, 5, 12])):
                w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
            rows.append(f"{passage} {' '.join(w)}" if passage and r.random() < 0.5 else " ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("frequent,dense", [(16, 24), (3, 2), (10**6, 24)])
def test_join_against_all_pairs(spark, monkeypatch, frequent, dense):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    docs = near_copies(8, 30, frequent, prose(4, 50))
    want = jaccard_components(docs)
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_join_of_three_shingles(spark):
    """7 and 8 words have 3 and 4 shingles, and link; 6 and 7 don't."""
    docs = []
    for k in range(30):
        w = prose(300 + k, 8).split()
        docs += [" ".join(w[:n]) for n in ((6, 7, 8) if k % 2 else (8, 7, 5))]
    same = prose(5, 6)
    docs += [f"{same} {a}" for a in ("one", "two", "one two", "two one", "one")]
    docs = list(enumerate(docs))
    want = jaccard_components(docs)
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_join_of_odd_texts(odd_docs, odd_texts, no_docs):
    want = jaccard_components(odd_texts)
    got = ngram_join.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_texts) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_signatures_meet():
    """Any two sets that link share a signature, whatever is rare or frequent."""
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(4, 120)
        a = set(r.sample(range(10**6), n))
        b = set(a)
        for _ in range(r.randint(0, n // 4)):
            b.discard(r.choice(sorted(b)))
            if r.random() < 0.5:
                b.add(r.randrange(10**6, 2 * 10**6))
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        frequent = {t for t in a | b if r.random() < r.choice([0, 0.3, 0.8, 1])}
        coded = [np.sort(np.array([t | (1 << 62 if t in frequent else 0) for t in s & (a & b)], np.int64)) for s in (a, b)]
        x, y = (set(ngram_join.signatures(len(s), t).tolist()) for s, t in zip((a, b), coded, strict=True))
        assert x & y or a == b


def test_shingle_blocks(monkeypatch):
    import pyarrow as pa

    texts = [prose(k, 30 * k) for k in range(12)] + ["", None, "a b", " x  " * 50]
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts))]
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(texts))] == whole
    assert [len(s) for s in whole[-4:]] == [0, 0, 1, 1]


def test_the_sketch_comes_to_the_driver_in_few_rows(spark, monkeypatch):
    """A row of Python a counter took the driver 100 MB."""
    kind, rows = type(spark.range(1)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: rows.append(collect(df)) or rows[-1])
    lines = spark.range(3000).select(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.xxhash64("id", i)).alias("words"))
    classes = line_dedup._classes(lines)
    assert len(classes) == line_dedup.SKETCH and max(map(len, rows)) <= line_dedup.SKETCH // 256
    counted = [0] * line_dedup.SKETCH
    for r in collect(lines.select(F.explode(F.transform(line_dedup._tokens(), lambda t: F.pmod(t, F.lit(line_dedup.SKETCH)))).alias("k"))):
        counted[r.k] += 1
    assert list(classes) == [int(np.floor(np.log2(c) * 3 + 1e-9)) if c else 0 for c in counted]


def test_only_lines_that_may_match_are_ordered(spark):
    """Every line that matches another is among the likely ones; lines of their own aren't, and no filter makes a line's words again."""
    r, texts = random.Random(11), []
    for k in range(150):
        w = prose(k, r.choice([1, 2, 4, 5, 6, 9, 30, 60])).split()
        texts.append(" ".join(w))
        if k % 3 == 0:
            for _ in range(r.choice([1, 1, 2])):
                w[r.choice([0, -1, r.randrange(len(w))])] = r.choice(["x", "y", w[0]])
            texts.append(" ".join(w))
    texts += ["a " * n + "a" for n in range(4, 9)] + ["a b " * n + "a" for n in range(2, 6)]
    texts = sorted(set(texts))
    rows = line_dedup._rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    lines = line_dedup._lines(rows)
    plan = lines.select("key", line_dedup._words().alias("words"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lambdafunction(") == 1 and "lower" not in "".join(x for x in plan.split("\n") if "Filter" in x)
    likely = {x.id for x in line_dedup._likely(line_dedup.Stages(spark), lines).select("at.id").collect()}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) for w in map(str.split, texts)]
    matching = {i for i, s in enumerate(sets) for j, t in enumerate(sets) if i != j and len(s & t) >= 0.75 * len(s | t)}
    alone = {i for i, s in enumerate(sets) if not any(s & t for j, t in enumerate(sets) if i != j)}
    assert len(matching) > 20 and matching <= likely and len(alone) > 50 and not {i for i in alone if len(set(sets[i])) > 1 and len(texts[i].split()) == len(set(texts[i].split()))} & likely

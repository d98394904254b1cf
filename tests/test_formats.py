import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from primeweave.functions.primes import carmichael_below
from primeweave.operators.divisors import least_valid
from primeweave.sources import codecs, formats, pwt2
from primeweave.sources.codecs import FormatError


@pytest.fixture(scope="module")
def table():
    return carmichael_below(10**9)


@pytest.fixture(scope="module")
def chosen(table):
    return [[p for p in f if least_valid(n, f)[0] % p == 0] for n, f in table]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 120) - 1)))
def test_vbytes(values):
    read = codecs.VByteReader(codecs.vbytes(values))
    assert [read() for _ in values] == values and read.at == len(read.data)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 5000), min_size=1, max_size=80))
def test_interpolative(values):
    v = sorted(values)
    width = max(1, v[-1].bit_length())
    assert codecs.interpolated(codecs.interpolate(v, width), len(v), width) == v


def test_centred_codes_are_prefix_free():
    for span in range(1, 70):
        words = []
        for v in range(span):
            w = codecs.BitWriter()
            codecs.put_centred(w, v, span)
            words.append("".join(w.parts))
            assert codecs.get_centred(codecs.BitReader(w.bytes()), span) == v
        assert len(set(words)) == span and not any(a != b and b.startswith(a) for a in words for b in words)


def test_rans_and_models():
    r = random.Random(3)
    counts = [{s: r.randrange(1, 900) for s in r.sample(range(300), k)} for k in (1, 2, 40, 250)]
    models = [codecs.Model(codecs.quantize(c)) for c in counts]
    pairs = [(m, r.choice(m.symbols)) for m in r.choices(models, k=3000)]
    coder = codecs.RansDecoder(codecs.rans_encode(pairs))
    assert [coder.get(m) for m, _ in pairs] == [s for _, s in pairs]
    coder.finish()
    for m in models:
        assert sum(m.freq.values()) == 65536
        assert codecs.read_model(codecs.VByteReader(codecs.model_bytes(m.freq)), 300) == m.freq


def test_quantizing_many_rare_symbols():
    f = codecs.quantize({0: 10**9, **dict.fromkeys(range(1, 4000), 1)})
    assert sum(f.values()) == 65536 and min(f.values()) == 1


def test_lists(table):
    n = [x for x, _ in table]
    assert formats.vbg1_decode(formats.vbg1_encode(n)) == n
    assert formats.read_raw16(formats.raw16(n)) == n
    for modulus in (1, 2, 30, 2310):
        assert formats.cnd_decode(formats.cnd_encode(n, modulus, formats.targets(n))) == n


def test_oracle_file(table):
    data = formats.orc1_encode(table)
    assert formats.orc1_decode(data) == table
    _, index, _, _ = formats.orc1_open(data)
    assert [formats.find_block(index, v) for v in (560, 561, 10**9)] == [1, 0, 0]


@pytest.mark.parametrize("bad", [(15, [3, 5]), (562, [3, 11, 17]), (99, [3, 3, 11]), (561, [11, 3, 17])])
def test_bad_records(bad):
    with pytest.raises(FormatError):
        formats.orc1_encode([bad])


def test_order_is_checked(table):
    with pytest.raises(FormatError):
        formats.orc1_encode(table[:2][::-1])
    with pytest.raises(FormatError):
        formats.vbg1_encode([5, 5])


@pytest.mark.parametrize("kind", [None, 1, 2, 3])
@pytest.mark.parametrize("full", [False, True])
def test_trees(table, chosen, kind, full):
    paths = [f for _, f in table] if full else chosen
    data = pwt2.encode(paths, formats.targets([n for n, _ in table]), full, kind)
    got = list(pwt2.decode(data))
    assert sorted(got) == sorted(paths) and sorted(pwt2.value_of(p, full) for p in got) == [n for n, _ in table]
    assert pwt2.encode(got, formats.targets([n for n, _ in table]), full, kind) == data


@pytest.mark.parametrize("make", ["orc1", "cnd", "pwt2", "naive"])
def test_changed_bits_are_noticed(table, chosen, make):
    t = formats.targets([n for n, _ in table])
    data, decode = {
        "orc1": (formats.orc1_encode(table), formats.orc1_decode),
        "cnd": (formats.cnd_encode([n for n, _ in table], 2310, t), formats.cnd_decode),
        "pwt2": (pwt2.encode(chosen, t), lambda x: list(pwt2.decode(x))),
        "naive": (pwt2.encode(chosen, t, False, None), lambda x: list(pwt2.decode(x))),
    }[make]
    r = random.Random(9)
    for _ in range(25):
        k = r.randrange(len(data) - (88 if make != "orc1" else 0))
        with pytest.raises((FormatError, IndexError, ValueError)):
            decode(data[:k] + bytes([data[k] ^ 1 << r.randrange(8)]) + data[k + 1 :])
    with pytest.raises(FormatError):
        decode(data + b"\0")
    with pytest.raises(FormatError):
        decode(data[:-1])


@pytest.mark.parametrize("kind", [None, 1, 3])
def test_resealed_changes_never_decode_to_the_same_set_with_other_values(chosen, table, kind):
    t = formats.targets([n for n, _ in table])
    data = pwt2.encode(chosen[:60], t, False, kind)
    r = random.Random(11)
    for _ in range(40):
        k = r.randrange(160, len(data) - 88)
        body = data[:k] + bytes([data[k] ^ 1 << r.randrange(8)]) + data[k + 1 : -88]
        try:
            got = list(pwt2.decode(body + hashlib.sha256(body).digest() + data[-56:]))
        except (FormatError, IndexError, ValueError):
            continue
        assert len(got) == 60 and sorted(got) != sorted(chosen[:60])


def test_small_prefix_hash(table):
    """All values below 10**9 as text, against the sum of their parts."""
    lines = [formats.text_line(n, f) for n, f in table]
    assert [formats.parse_line(x.rstrip("\n")) for x in lines] == table and all(math.prod(f) == n for n, f in table)


def test_paths_and_masks(chosen):
    data = b"".join(formats.path_record(p, 12) for p in chosen)
    assert formats.read_paths(data, 12) == chosen
    with pytest.raises(FormatError):
        formats.read_paths(data[:-1], 12)
    assert formats.read_masks(formats.masks([1, 2, 65535])) == [1, 2, 65535]
    assert [formats.sniff(x) for x in (formats.ORC1, b"PWT2....", b"zzzz")] == ["orc1", "pwt2", None]


def test_only_the_coding_of_a_tree_is_one_task(spark, tmp_path):
    """What makes the paths keeps its own tasks."""
    from pyspark import TaskContext

    from primeweave.sources import files

    def made(frames):
        (tmp_path / f"task-{TaskContext.get().taskAttemptId()}").touch()
        for frame in frames:
            yield frame.assign(path=[[3, int(p)] for p in frame["id"]])[["path"]]

    paths = spark.createDataFrame([(p,) for p in (5, 7, 11, 13)], "id long").repartition(4, "id").mapInPandas(made, "path array<long>")
    values = spark.createDataFrame([(3 * p,) for p in (5, 7, 11, 13)], "n long")
    files.register(spark)
    files.write_pwt2(paths, str(tmp_path / "tree"), files.n_targets(values), full=True, kind=None)
    assert len(list(tmp_path.glob("task-*"))) > 1
    assert sorted(int(r.n) for r in spark.read.format("pwt2").load(str(tmp_path / "tree")).collect()) == [15, 21, 33, 39]

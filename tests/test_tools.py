import pytest
from pyspark.sql import functions as F

from primeweave.functions.primes import carmichael_below
from primeweave.operators import compare
from primeweave.sources import files, formats, tools


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The values below 10**9 as records, text and ORC1."""
    files.register(spark)
    folder = str(tmp_path_factory.mktemp("tools"))
    rows = carmichael_below(10**9)
    frame = spark.createDataFrame([(str(n), f) for n, f in rows], "n string, factors array<long>").select(F.col("n").cast("decimal(38,0)").alias("n"), "factors")
    files.write_text(frame, f"{folder}/text")
    report = tools.encode_records(spark, f"{folder}/text", f"{folder}/orc1", prove_primes=True).first()
    assert (report.record_count, int(report.total_check)) == (len(rows), sum(n for n, _ in rows))
    return folder, rows


def test_broken_records_stop_the_job(spark, tmp_path):
    files.register(spark)
    for k, (line, why) in enumerate([("561 3 11 17 ", "line"), ("562 3 11 17", "product"), ("4199 13 17 19", "korselt"), ("33 3 11", "size")]):
        (tmp_path / f"t{k}").write_text(line + "\n")
        with pytest.raises(ValueError, match=why):
            tools.encode_records(spark, str(tmp_path / f"t{k}"), str(tmp_path / "o"))


def test_pseudoprime_factors_need_a_proof(spark, tmp_path):
    """15 passes every rule of a factor but being prime: 3 * 15 * ... is no table value, so Korselt's rule is met on purpose."""
    found = [(a, b, c) for a in (9, 15, 21, 25) for b in range(a + 2, 400, 2) for c in range(b + 2, 800, 2) if all((a * b * c - 1) % (x - 1) == 0 for x in (a, b, c))][0]
    (tmp_path / "t").write_text(" ".join(map(str, (found[0] * found[1] * found[2], *found))) + "\n")
    files.register(spark)
    with pytest.raises(ValueError, match="prime"):
        tools.encode_records(spark, str(tmp_path / "t"), str(tmp_path / "o"), prove_primes=True)


def test_filters_choose_blocks(spark, table, monkeypatch):
    folder, rows = table
    monkeypatch.setattr(formats, "BLOCK", 64)
    data = formats.orc1_encode(rows)
    with open(f"{folder}/small", "wb") as f:
        f.write(data)

    class Source:
        options = {"path": f"{folder}/small"}

    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    def blocks(*filters):
        reader = files._Orc1Reader(Source)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [b[0] for part in reader.partitions() if part.what[0] for b in part.what[0]]

    every = list(range(-(-len(rows) // 64)))
    assert blocks() == every and blocks(EqualTo(("block_id",), 2)) == [2]
    assert blocks(GreaterThan(("rank",), 100), LessThanOrEqual(("rank",), 200)) == [1, 2, 3]
    assert blocks(EqualTo(("n",), rows[70][0])) == [1] and blocks(EqualTo(("n",), 1)) == []


def test_lists_certify_or_fail(spark, table):
    folder, rows = table
    total = tools.divisor_list(spark, f"{folder}/d.raw", orc1=f"{folder}/orc1").first()
    assert total.record_count == len(rows)
    assert tools.decode_list(spark, f"{folder}/d.raw", "d", f"{folder}/orc1")[1].first().verdict == compare.CERTIFIED
    assert tools.decode_list(spark, f"{folder}/d.raw", "d")[1].first().verdict == compare.DECODED
    wrong = spark.read.format("orc1").load(f"{folder}/orc1").where("rank <> 5")
    files.write_orc1(wrong, f"{folder}/fewer")
    assert tools.decode_list(spark, f"{folder}/d.raw", "d", f"{folder}/fewer")[1].first().verdict == compare.FAILED


def test_values_of_divisors():
    assert tools.value_of_divisor(9) is None and tools.value_of_divisor(6) is None
    for n, f in carmichael_below(10**6):
        from primeweave.operators.divisors import least_valid

        assert tools.value_of_divisor(least_valid(n, f)[0]) == n


def test_statistics_and_benches(spark, table):
    folder, rows = table
    assert tools.list_statistics(spark, f"{folder}/orc1").first().n == len(rows)
    report = tools.export_paths(spark, f"{folder}/orc1", f"{folder}/paths").first()
    assert report.paths == len(rows) and report.longest <= 14
    bench = tools.cofactor_bench(spark, f"{folder}/orc1", f"{folder}/paths", 14, stride=3).first()
    assert bench.records == -(-len(rows) // 3) and bench.wrong == 0


def test_keys_and_manifests(spark, tmp_path):
    (tmp_path / "m").write_text("# remark\nNAME = some thing = else\nSIZE=3\nno key here\n")
    assert {r.key: r.value for r in tools.read_keys(spark, str(tmp_path / "m")).collect()} == {"NAME": "some thing = else", "SIZE": "3"}
    (tmp_path / "a").write_bytes(b"abc")
    found = tools.digests(spark, [str(tmp_path / "a")])
    tools.write_manifest(found, str(tmp_path / "listed"))
    assert [r.verdict for r in tools.check_files(spark, str(tmp_path / "listed")).collect()] == [compare.VERIFIED]
    (tmp_path / "a").write_bytes(b"abd")
    assert [r.verdict for r in tools.check_files(spark, str(tmp_path / "listed")).collect()] == [compare.FAILED]
